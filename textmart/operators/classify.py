"""Labels from keyword dictionaries, as expressions: no UDF, no join, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed

Keywords = Mapping[str, Sequence[str]]


def load_dictionary(spark: SparkSession, path: str) -> dict:
    """A JSON object of label to keywords, or of scope to such an object."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _literal(rows: list[dict], schema: str) -> Column:
    # Catalyst folds this to one array literal.
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def _votes(entries: Keywords, texts: Sequence[Column], gate: Column | None, dedupe: bool) -> Column:
    """The label with most votes, null if there is no vote; the earlier label wins a tie."""
    rows = [
        {"ord": -i, "label": label, "keywords": list(dict.fromkeys(words) if dedupe else words)}
        for i, (label, words) in enumerate(entries.items())
    ]
    texts = [F.coalesce(t, F.lit("")) for t in texts]
    labels = _literal(rows, "ord:int,label:string,keywords:array<string>")

    def in_any_text(word: Column) -> Column:
        found = texts[0].contains(word)
        for text in texts[1:]:
            found = found | text.contains(word)
        return found

    if gate is not None:
        gate = F.coalesce(gate, F.lit(""))
        labels = F.filter(labels, lambda d: F.exists(d["keywords"], lambda word: gate.contains(word)))
    tally = F.transform(labels, lambda d: F.struct(
        F.size(F.filter(d["keywords"], in_any_text)).alias("n"), d["ord"].alias("ord"), d["label"].alias("label")))
    return F.array_max(F.filter(tally, lambda t: t["n"] > 0))["label"]


def classify_vote(texts: Sequence[Column], keywords: Keywords, gate: Column | None = None,
                  fallback: Keywords | None = None, default: str | None = fixed.UNCLASSIFIED,
                  dedupe: bool = False) -> Column:
    """Label by keyword votes.

    Every keyword found in any of `texts` is a vote for its label; one listed twice votes twice
    unless `dedupe`. With `gate`, only labels with a keyword in the gate text take part. Without
    any vote, the labels of `fallback` whose keywords are in the gate text decide, then `default`.
    """
    label = _votes(keywords, texts, gate, dedupe)
    if fallback:
        label = F.coalesce(label, _votes(fallback, [gate], None, dedupe))
    return F.coalesce(label, F.lit(default)) if default is not None else label


def classify_first(text: Column, scope: Column, aliases: Mapping[object, Keywords],
                   match: str = "first") -> Column:
    """The label of an alias found in `text`, among the aliases of the row's `scope`; else null.

    `match` picks among several: the first listed, the longest, or only one equal to the text.
    """
    rows = [
        {"scope": str(s), "ord": -i, "size": len(alias), "label": label, "alias": alias}
        for s, labels in aliases.items()
        for i, (label, alias) in enumerate((lb, a) for lb, listed in labels.items() for a in listed)
    ]
    listed = _literal(rows, "scope:string,ord:int,size:int,label:string,alias:string")
    same_scope = lambda e: e["scope"] == scope.cast("string")
    if match == "exact":
        found = F.filter(listed, lambda e: same_scope(e) & (e["alias"] == text))
    else:
        found = F.filter(listed, lambda e: same_scope(e) & text.contains(e["alias"]))
    if match == "longest":
        return F.array_max(F.transform(found, lambda e: F.struct(e["size"], e["ord"], e["label"].alias("label"))))["label"]
    return F.get(found, F.lit(0))["label"]
