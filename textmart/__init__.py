"""textmart: Spark table operators that turn loosely structured text records into a star schema."""
