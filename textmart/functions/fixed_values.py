"""Patterns, rules, words and constants that results depend on.

They are data. Every function that uses one takes it as a parameter, so a caller can pass others.
"""

# Text cleaning: characters that become a space.
# WIDE holds an unescaped "," to "؛" range, which removes every ASCII letter and digit.
CLEAN_REPORT = r"[⸮():.,\-؛،ـ_؟]"
CLEAN_REPORT_WIDE = r"[⸮\(\):\.,-؛،ـ_؟]"
CLEAN_NGRAM = r'[⸮–()•\\/\d":.,\-؛،ـ_؟]'

# Text cleaning: article rules that follow the character class, in order.
ARTICLE_RULES = [
    (" وال", " ال"),
    (" ال ", " "),
]

# Word boundaries of the report tokenizer.
TOKEN_GAPS = r'[\s\-,"؛،.ـ_:]'

# Delimiters between members named in one cell.
MEMBER_DELIMITERS = "[,،]"

# Group labels, in order.
GROUP_RULES = [
    ("-", " "),
    ("  ", " "),
    ("^ +| +$", ""),
    ("وال", "و ال"),
]

# Misspelt member names, in order.
MEMBER_RULES = [
    ("بلافريج عمر", "عمر بلافريج"),
    ("^فيقة لشرف$", "شفيقة لشرف"),
]

# Name comparison key, in order, between squeezing and sorting of the name's words.
NAME_KEY_RULES = [
    ("عبب?د ال", "عبدال"),
    ("[آأإ]", "ا"),
    ("[ئى]", "ي"),
    ("ال", ""),
    ("مولاي", ""),
]

# Member whose party no table gives.
PARTY_OVERRIDES = {"سعيدة زهير": "UC"}

# Roster label of members outside any group.
NO_GROUP = "sans_groupe"

# Legislatures by period; the order is the order of the periods.
TERMS = {"2016-2021": 10, "2021-2026": 11}

# Label of a question no dictionary classifies.
UNCLASSIFIED = "غير مصنف"

# Cell that stands for a missing value.
MISSING_CELL = "-"

# Stop words that are added to the caller's Arabic list in every word report.
REPORT_STOP_WORDS = [
    "لذا", "وفي", "تم", "وحيث", "وذلك", "والتي", "وعليه", "أنه", "ظل", "حول", "عبر", "عليها", "يتم",
    "لذلك", "وكذا", "لهذه",
]

# Stop words that are added to those in the n-gram report.
NGRAM_STOP_WORDS = [
    "السيد", "الوزير", "المحترم", "نسائلكم", "الإجراءات", "التدابير", "الحكومة", "وزارتكم",
    "ستتخذونها", "خلال", "مستوى", "أسائلكم", "إطار", "المتخذة", "السيدة", "عدد", "العديد", "سنة",
    "الوزيرة", "طرف", "القطاع", "الأمر", "بشكل", "بسبب", "رقم", "مختلف", "المحترمة", "مجموعة",
    "فإننا", "عدم", "سيدي", "بهذه", "رغم", "لهذا", "عدة", "تعتزمون", "ستتخذها", "الأخيرة", "سواء",
    "وعن", "المتعلق", "حالة", "يعتبر", "بقبول", "سنوات", "رئيس", "كبيرة", "وقد", "الاستفادة",
    "السنة", "توفير", "أسباب", "•", "\u200f", "التعليمية", "المحلية", "العامة", "يلي", "تعلمون",
    "علما", "عبارات", "لأجل", "بتاريخ", "وأن", "تحقيق", "لفائدة", "تعتبر", "وعلى", "حصيلة", "سبق",
    "دعم", "ضمن", "المعنية", "الأطر", "الى", "ظروف", "الاجراءات", "كانت", "يعاني", "وتفضلوا",
    "فائق", "مهمة", "الخاص", "تنزيل", "كبيرا", "وخاصة", "وبعد", "لماذا", "التقدير", "الاحترام",
    "تحية", "تقدير", "واحترام", "يخفى", "عليكم", "نصره", "الله", "تنوون", "القيام", "اتخاذها",
    "بعين", "الاعتبار", "احترام", "قامت", "بهذا", "يتعلق", "تعرف", "بالنسبة",
]

# Near duplicates: largest Jaccard distance (exclusive) and number of hash tables.
MAX_DISTANCE = 0.2
HASH_TABLES = 5

# Term vectors: number of hash buckets.
HASH_BUCKETS = 10_000

# Report lengths: content words, subject words, n-grams; longest n-gram.
TOP_CONTENT_WORDS = 200
TOP_SUBJECT_WORDS = 100
TOP_NGRAMS = 100
NGRAM_SIZE = 3
VOCABULARY_SIZE = 1 << 18
