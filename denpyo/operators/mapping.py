"""Entries to document fields by declarative rules.

Rules are small driver-side dictionaries. They compile to expressions over the entries of a
row, so mapping needs no shuffle. `lookup_long` is the form for rule tables too large to
fold into a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import listed, normalize_key, normalize_key_text, sql_text, substrings
from ..functions.transforms import compile_chain
from ..sources.files import materialize
from . import skew

NUMERIC_TARGETS = ("grand_total", "subtotal", "tax")
_SEP = "\x01"


# Rules ------------------------------------------------------------------------------------


def merge_layers(base: dict, override: dict, list_merge: str = "concat") -> dict:
    """Deep merge. Lists of the later layer are appended ("concat", so the earlier layer's
    sources are tried first) or put in front of the earlier ones ("override")."""
    out = dict(base)
    for key, value in override.items():
        old = out.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            out[key] = merge_layers(old, value, list_merge)
        elif isinstance(old, list) and isinstance(value, list):
            fresh = [v for v in old if v not in value]
            out[key] = old + value if list_merge == "concat" else value + fresh
        else:
            out[key] = value
    return out


def layered_rules(doc_type: str, vendor_layer: dict | None = None,
                  list_merge: str = "concat") -> dict:
    """Global, then document type, then vendor rules."""
    out = merge_layers(rules.GLOBAL_MAPPING, rules.TYPE_MAPPING.get(doc_type, {}), list_merge)
    return merge_layers(out, vendor_layer, list_merge) if vendor_layer else out


def rule_variants(vendor_layers: dict | None = None,
                  list_merge: str = "concat") -> list[tuple[str, str | None, dict]]:
    """(doc_type, vendor, merged rules); rules of a vendor come before those of its type."""
    out = [
        (t, vendor, layered_rules(t, layer, list_merge))
        for (t, vendor), layer in (vendor_layers or {}).items()
    ]
    return out + [(t, None, layered_rules(t, None, list_merge)) for t in rules.TYPE_MAPPING]


def _by_variant(variants: list, build, default: Column) -> Column:
    """CASE over document type and vendor, folded where several variants agree."""
    grouped: list[tuple[list[Column], object]] = []
    for doc_type, vendor, own in variants:
        guard = F.col("doc_type") == doc_type
        if vendor is not None:
            guard = guard & F.col("vendor").eqNullSafe(vendor)
        if grouped and grouped[-1][1] == own:
            grouped[-1][0].append(guard)
        else:
            grouped.append(([guard], own))
    out = default
    for guards, own in reversed(grouped):
        guard = guards[0]
        for g in guards[1:]:
            guard = guard | g
        built = build(own)
        if built is not None:
            out = F.when(guard, built).otherwise(out)
    return out


def targets(variants: list) -> list[str]:
    seen: dict[str, None] = {}
    for doc_type in reversed(variants):
        seen.update(dict.fromkeys(t for t in doc_type[2].get("mappings", {}) if t != "lines"))
    return list(seen)


# Lookup -----------------------------------------------------------------------------------


def with_keys(df: DataFrame, entries: str = "entries") -> DataFrame:
    """Prepare comparison forms of the keys once per row, for all lookups on it."""
    keys = F.transform(F.col(entries), lambda e: e["key"])
    return (
        df.withColumns({
            "_lower": F.transform(keys, F.lower),
            "_norm": F.transform(keys, normalize_key),
        })
        .withColumn("_all_norm", F.array_join("_norm", _SEP))
    )


def lookup(sources: list[str], entries: str = "entries") -> Column:
    """Entry of the first source that has any: a key equal after normalization or one that
    contains the source, in key order. Null if there is none; the entry's value may be null.

    Keys live in arrays parallel to the entries, so positions are filtered, not entries.
    """
    branches = []
    for source in sources:
        lower = sql_text(source.lower())
        norm = sql_text(normalize_key_text(source))
        # A key that contains the source also does so after normalization, hence one test
        # over all keys rules out both ways to match; most sources end here.
        branches.append(
            f"if(contains(_all_norm, {norm}),"
            f" get({entries}, get(filter(sequence(0, size({entries}) - 1),"
            f" i -> get(_norm, i) = {norm} or contains(get(_lower, i), {lower})), 0)), null)"
        )
    # SQL text, because a plan over many rules is built much faster from it than by calls.
    return F.expr(f"coalesce({', '.join(branches)}, null)")


def with_mapped_fields(df: DataFrame, variants: list | None = None) -> DataFrame:
    """Add t_<target> for every target and `null_targets`, the targets whose key was found
    but whose transforms gave null. What `with_rule_table` has found stands for the sources of `variants`."""
    variants = rule_variants() if variants is None else variants
    names = targets(variants)
    staged = df if "_all_norm" in df.columns else with_keys(df)
    nothing = F.lit(None).cast("string")

    found = {}
    for t in names:
        if "_found" in df.columns:
            found[f"_e_{t}"] = F.try_element_at("_found", F.lit(t))
            continue
        sources = [(d, v, r["mappings"].get(t, {}).get("from", [])) for d, v, r in variants]
        found[f"_e_{t}"] = _by_variant(sources, lambda s: lookup(s)["value"] if s else None, nothing)
    staged = staged.withColumns(found)

    mapped = {}
    for t in names:
        own = [(d, v, _rest(r["mappings"].get(t))) for d, v, r in variants]
        kind = "double" if t in NUMERIC_TARGETS else "string"
        raw = F.col(f"_e_{t}")
        mapped[f"t_{t}"] = _by_variant(
            own, lambda rule, raw=raw, kind=kind: _converted(raw, rule, kind),
            F.lit(None).cast(kind),
        )
    staged = staged.withColumns(mapped)
    nulls = [(F.col(f"_e_{t}").isNotNull() & F.col(f"t_{t}").isNull(), F.lit(t)) for t in names]
    return staged.withColumn("null_targets", listed(nulls, "array<string>")).drop(*[f"_e_{t}" for t in names])


def _rest(rule: dict | None):
    return (tuple(rule.get("transform", [])), rule.get("default")) if rule else None


def _converted(raw: Column, rule, kind: str) -> Column | None:
    if rule is None:
        return None
    chain, default = rule
    value = compile_chain(raw, chain)
    out = value.col if value.kind == kind else value.text().try_cast(kind)
    if default is None:
        return out
    return F.when(raw.isNull(), F.lit(default).cast(kind)).otherwise(out)


def unmapped_fields(variants: list | None = None, entries: str = "entries", table: bool = False) -> Column:
    """Entries whose key equals no source of any rule, sorted by key: (field, value, source).

    Needs `with_keys`, and `with_rule_table` if the sources are those of a table. Values are cut to 100
    characters, as the report is defined.
    """
    variants = rule_variants() if variants is None else variants

    sources = [
        (d, v, sorted({normalize_key_text(s) for m in r["mappings"].values() for s in m.get("from", [])}))
        for d, v, r in variants
    ]

    def known(e: Column, i: Column) -> Column:
        if table:
            return F.array_contains("_known", e["key"])
        key = F.get("_norm", i)  # a test against many literals is one look into a set
        return _by_variant(sources, lambda names: key.isin(names) if names else None, F.when(key.isNotNull(), F.lit(False)))

    def shown(e: Column) -> Column:
        return F.coalesce(F.nullif(e["field_value"], F.lit("")), F.nullif(e["value"], F.lit("")))

    rest = F.filter(F.col(entries), lambda e, i: ~known(e, i) & shown(e).isNotNull())
    return F.array_sort(F.transform(rest, lambda e: F.struct(
        e["key"].alias("field"), F.left(shown(e), F.lit(100)).alias("value"), e["source"].alias("source"))))


# Long form --------------------------------------------------------------------------------


def rule_rows(spark, variants: list | None = None) -> DataFrame:
    """Rules as rows: (doc_type, vendor, target, priority, source); vendor is null for the rules
    of a whole type."""
    variants = rule_variants() if variants is None else variants
    rows = [
        (d, v, t, i, s)
        for d, v, r in variants
        for t, m in r["mappings"].items() for i, s in enumerate(m.get("from", []))
    ]
    return spark.createDataFrame(
        rows, "doc_type string, vendor string, target string, priority int, source string")


#: Pairs of key and rule that are broadcast at most, and pieces a key is spread over beyond that.
SENT_HITS, SALTS = 100_000, 64


def lookup_long(docs: DataFrame, rule_table: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`lookup` against a rule table: (doc_id, target, key, value) per target with a hit.

    The documents are read twice, so they should be a stored table. Keys repeat from document to
    document, so the rules are matched with the distinct keys only. "Contains" is an equi join
    too: a source can only be contained in a key as one of the key's substrings of a length that
    some source has. What matches is counted: up to SENT_HITS pairs are broadcast and chosen from
    inside each row, without a shuffle; more are joined to the entries, spread over SALTS pieces
    of each key, as a key may occur in every document.

    A document follows the rules of its vendor if there are any, else those of its type.
    """
    ruled, hits = _rule_hits(docs, rule_table, doc_id, "doc_type", "entries")
    if hits.count() > SENT_HITS:
        return (
            _entry_hits(ruled, hits, doc_id)
            .groupBy(doc_id, "h.target")
            .agg(F.min_by("h", F.struct("h.priority", "h.pos")).alias("hit"))
            .select(doc_id, "hit.target", "hit.key", "hit.value")
        )
    return _with_row_hits(ruled, hits).select(doc_id, F.explode(_first_hits()).alias("h")).select(
        doc_id, "h.target", "h.key", "h.value")


def with_rule_table(docs: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Rows with `_found`, a map from each target that a rule of the table hits to the entry's value, and
    `_known`, the keys that equal a source; chosen as in `lookup_long`. Rows are judged one by one, whatever
    their ids. The documents are stored; they are shuffled only if more than SENT_HITS pairs match."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "ruled-rows")
    ruled, hits = _rule_hits(rows, rule_table, *rows.columns)
    if hits.count() > SENT_HITS:
        own = _entry_hits(ruled, hits, "_row").groupBy("_row").agg(F.array_sort(F.collect_list("h")).alias("_all"))
        ruled = ruled.join(own, "_row", "left").withColumn("_all", F.coalesce("_all", F.array().cast(_HITS)))
    else:
        ruled = _with_row_hits(ruled, hits)
    return ruled.withColumns({
        "_found": F.map_from_entries(F.transform(_first_hits(), lambda h: F.struct(h["target"], h["value"]))),
        "_known": F.transform(F.filter("_all", lambda h: h["same"]), lambda h: h["key"]),
    }).drop("_row", "_vendor", "_all")


_TO = "array<struct<target:string,priority:int,same:boolean>>"
_HITS = "array<struct<target:string,priority:int,pos:int,key:string,value:string,same:boolean>>"


def _rule_hits(docs: DataFrame, rule_table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The documents with `_vendor`, whose rules they follow, and (doc_type, _vendor, key, target, priority, same) of the
    distinct keys that a rule matches; `same` tells whether the key equals a source of the target."""
    table = rule_table.withColumns({
        "_lower": F.lower("source"), "_norm": normalize_key(F.col("source")),
        "vendor": F.coalesce("vendor", F.lit("")),
    })
    layered = table.select("doc_type", "vendor").distinct().filter("vendor <> ''").withColumn("_own", F.lit(True))
    own_vendor = F.when(F.col("_own"), F.col("vendor")).otherwise("").alias("_vendor")
    named = docs if "vendor" in docs.columns else docs.withColumn("vendor", F.lit(None).cast("string"))
    # A few types and vendors own all documents, so a shuffle by them would end in a few tasks.
    if skew.small(layered):
        ruled = named.join(F.broadcast(layered), ["doc_type", "vendor"], "left").select(*columns, own_vendor)
    else:
        row = "_row" if "_row" in columns else columns[0]
        salted = named.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
        every = layered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ruled = salted.join(every, ["doc_type", "vendor", "_salt"], "left").select(*columns, own_vendor)
    vocabulary = ruled.select("doc_type", "_vendor", F.explode("entries.key").alias("key")).distinct()
    # One row per distinct source length; the number of lengths is bounded by the longest name.
    lengths = [r[0] for r in table.select(F.length("_lower")).distinct().collect() if r[0]]
    windows = [substrings(F.col("_k"), n) for n in sorted(lengths)] or [F.array().cast("array<string>")]
    parts = vocabulary.withColumn("_k", F.lower("key")).withColumn(
        "_lower", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*windows))))))
    rule = table.withColumnRenamed("vendor", "_vendor")
    pair = ["doc_type", "_vendor", "key", "target", "priority"]
    contained = parts.join(rule, ["doc_type", "_vendor", "_lower"]).select(*pair, F.lit(False).alias("same"))
    equal = vocabulary.withColumn("_norm", normalize_key(F.col("key"))).join(
        rule, ["doc_type", "_vendor", "_norm"]).select(*pair, F.lit(True).alias("same"))
    hits = contained.unionByName(equal).groupBy("doc_type", "_vendor", "key", "target").agg(
        F.min("priority").alias("priority"), F.max("same").alias("same"))
    return ruled, materialize(hits, "rule-hits")


def _entry_hits(ruled: DataFrame, hits: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, h) for each entry and rule that match, by a join."""
    entries = ruled.select(doc_id, "doc_type", "_vendor", F.posexplode("entries").alias("pos", "e")).select(
        doc_id, "doc_type", "_vendor", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"),
        F.pmod(F.xxhash64(doc_id, "pos"), F.lit(SALTS)).cast("int").alias("_salt"))
    spread = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return entries.join(spread, ["doc_type", "_vendor", "key", "_salt"]).select(
        doc_id, F.struct("target", "priority", "pos", "key", "value", "same").alias("h"))


def _with_row_hits(ruled: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents with `_all`, what matches their entries, by target, priority and place."""
    by_key = hits.groupBy("doc_type", "_vendor", "key").agg(F.collect_list(F.struct("target", "priority", "same")).alias("to"))
    by_type = by_key.groupBy("doc_type", "_vendor").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "to"))).alias("_hits"))

    def found(e: Column, pos: Column) -> Column:
        return F.transform(F.coalesce(F.try_element_at("_hits", e["key"]), F.array().cast(_TO)), lambda h: F.struct(
            h["target"].alias("target"), h["priority"].alias("priority"), pos.alias("pos"),
            e["key"].alias("key"), e["value"].alias("value"), h["same"].alias("same")))

    ordered = F.array_sort(F.flatten(F.transform("entries", found)))
    return ruled.join(F.broadcast(by_type), ["doc_type", "_vendor"], "left").withColumn(
        "_all", F.coalesce(ordered, F.array().cast(_HITS))).drop("_hits")


def _first_hits() -> Column:
    """Of `_all` the first for each target."""
    return F.filter("_all", lambda x, i: (i == 0) | (x["target"] != F.get("_all", i - 1)["target"]))
