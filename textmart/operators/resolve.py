"""Which label (party) a named entity (member) has."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed
from textmart.functions import text as tx
from textmart.operators.joins import BLOCK_ROWS, lookup, meet
from textmart.sources.tables import materialize


def unique_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """The keys that come with exactly one value (null counts as a value)."""
    seen = df.groupBy(key).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_known"), F.count(F.lit(1)).alias("_rows"))
    return seen.where("_known = 0 OR _known = _rows AND _low = _high").select(key)


def fuzzy_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs of keys at most one edit apart: (*on, key, other_key, edits).

    Both sides are reduced to distinct keys per block `on`. Then they meet on a shared
    one-deletion variant, so no block is paired off in full. Variants of more than `block_rows` keys are
    split on both sides (`joins.meet`).
    """
    on = list(on)

    def variants(df: DataFrame, name: str) -> DataFrame:
        keys = df.select(*on, F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct()
        return keys.withColumn("_variant", F.explode(tx.one_edit_variants(F.col(name))))

    edits = F.levenshtein("_left", "_right", 1)
    return (
        meet(variants(left, "_left"), variants(right, "_right"), [*on, "_variant"], block_rows)
        .where(edits >= 0)
        .select(*on, F.col("_left").alias(key), F.col("_right").alias("other_key"), edits.alias("edits"))
        .distinct()
    )


def _mapping(values: Mapping[str, str], key: Column) -> Column:
    literal = F.from_json(F.lit(json.dumps(dict(values), ensure_ascii=False)), "map<string,string>")
    return F.try_element_at(literal, key)


def fuzzy_labels(unresolved: DataFrame, roster: DataFrame, name_rules: tx.Rules = fixed.NAME_KEY_RULES,
                 no_group: str = fixed.NO_GROUP) -> DataFrame:
    """Roster labels of similarly named members in the same term, and in the same group or in none.

    (name, grp, term) against (term, name, grp, label) gives (name, grp, term, label, edits), with the
    fewest edits for each label.
    """
    keyed = unresolved.select(
        "name", "grp", "term", tx.comparison_key(F.col("name"), name_rules).alias("key"))
    listed = roster.where("label is not null").select(
        "term", "grp", "label", tx.comparison_key(F.col("name"), name_rules).alias("key")).distinct()
    ungrouped = listed.where(F.col("grp") == no_group).drop("grp")
    same = fuzzy_pairs(keyed, listed, ["term", "grp"], "key")
    anyone = fuzzy_pairs(keyed, ungrouped, ["term"], "key")
    by_group = keyed.join(same, ["term", "grp", "key"]).join(
        listed.withColumnRenamed("key", "other_key"), ["term", "grp", "other_key"])
    by_none = keyed.join(anyone, ["term", "key"]).join(
        ungrouped.withColumnRenamed("key", "other_key"), ["term", "other_key"])
    wanted = ["name", "grp", "term", "label", "edits"]
    return by_group.select(*wanted).unionByName(by_none.select(*wanted)).groupBy(*wanted[:-1]).agg(
        F.min("edits").alias("edits"))


def resolve_labels(mentions: DataFrame, roster: DataFrame, ambiguous: str = "best",
                   overrides: Mapping[str, str] = fixed.PARTY_OVERRIDES,
                   name_rules: tx.Rules = fixed.NAME_KEY_RULES, no_group: str = fixed.NO_GROUP) -> DataFrame:
    """Label each distinct (name, grp, term) of `mentions` from roster (term, name, grp, label).

    1. A group with a single label in the roster gives its members that label, term by term.
    2. The others take the label of a similarly named roster member (`fuzzy_labels`): the closest,
       then the smallest label; or with ambiguous="all" every label found, one row each.
    3. `overrides` (name to label) have the last word.

    `method` tells which step decided and `candidates` how many labels step 2 found. The roster's
    groups are expected in the same spelling as the mentions'.
    """
    mentions = mentions.select("name", "grp", "term").distinct()
    grouped = roster.where(F.col("grp") != no_group).select("term", "grp", "label").distinct()
    by_group = materialize(grouped.join(unique_mapping(grouped, "grp", "label"), "grp"), "group-labels")
    direct = materialize(lookup(mentions, by_group, ["grp", "term"]), "direct-labels")
    found = fuzzy_labels(direct.where("label is null"), roster, name_rules, no_group)

    who = ["name", "grp", "term"]
    if ambiguous == "best":
        found = found.groupBy(*who).agg(
            F.min(F.struct("edits", "label"))["label"].alias("fuzzy_label"),
            F.count(F.lit(1)).alias("candidates"))
    else:
        found = found.select(
            *who, F.col("label").alias("fuzzy_label"),
            F.count(F.lit(1)).over(Window.partitionBy(*who)).alias("candidates"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in who]
    joined = direct.alias("d").join(found.alias("f"), same, "left")
    forced = _mapping(overrides, F.col("name"))
    return joined.select(
        "d.name", "d.grp", "d.term", "d.label", "fuzzy_label", "candidates",
    ).select(
        *who,
        F.coalesce(forced, "label", "fuzzy_label").alias("label"),
        F.when(forced.isNotNull(), "override").when(F.col("label").isNotNull(), "group")
        .when(F.col("fuzzy_label").isNotNull(), "name").alias("method"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )
