"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

A *version* is a row ``(path, text)``: a document, or one of its historical states. Its blob is the SHA-256 of the text, so
any number of paths and versions that hold the same text are one blob. The ledger is a table with one row for each
``(blob, rule_version)`` that has been scanned, with its findings (possibly none). A scan takes the blobs of the versions,
leaves out every pair that the ledger has, reads the text of the others once, appends their findings, and joins findings
back to all paths.

Positions are code points, end exclusive. For a rule they come from the pieces between matches and the matches
themselves: a running sum of their lengths in text order.

Defined results: a null text is an empty text (no spans); null or repeated paths keep their rows; an empty table gives an
empty table; texts of any length are scanned whole; extra columns are not read. One blob held by a third of all rows is
folded before the shuffle, and meets its paths again in a join of narrow rows that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.llm.common import fresh, shared_path, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one counts if ``group`` of it has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None  # a literal that every match holds: a text without it is not searched


@dataclass(frozen=True)
class RuleSet:
    """Rules of one version; a change of any rule needs a new version, so that the ledger scans every blob anew."""

    version: str
    rules: tuple[Rule, ...]


#: The base rules. A run of at least n characters of one class is the maximal run that has n or more.
BASE_RULES = RuleSet(
    "base-1",
    (
        Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
        Rule("hex", r"[0-9a-f]{24,}"),
    ),
)
#: Further kinds that this ledger adds.
EXTRA_RULES = RuleSet(
    "extra-1",
    (
        Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    ),
)
RULE_SETS = (BASE_RULES, EXTRA_RULES)
ORDER = [rule.kind for rules in RULE_SETS for rule in rules.rules]
_FINDINGS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_LEDGER = f"blob string, rule_version string, findings {_FINDINGS}"


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


_HIT = "array<struct<kind:string,at:int,gap:bigint,size:bigint,ok:boolean>>"


def _hits(text: Column, rule: Rule) -> Column:
    """For each match of the rule in text order: the characters between it and the one before, its own, whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))  # one more than matches: the rest of the text
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    marks = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), marks.alias("ok")),
        lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("at"), x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), x["ok"].alias("ok")),
    )
    test = text.rlike(rule.pattern)
    if rule.hint:
        test = text.contains(rule.hint) & test
    return F.when(test, F.filter(found, lambda x: x["size"].isNotNull())).otherwise(F.array().cast(_HIT))


def findings(pending: DataFrame, rule_sets: tuple[RuleSet, ...]) -> DataFrame:
    """Ledger rows ``blob, rule_version, findings`` of ``pending (blob, text, done)``, blobs without findings included.

    ``done`` lists the rule versions that have scanned the blob already. One pass over the texts; everything after it is
    narrow and stays on the blob's partition.
    """
    sets = F.array(
        *(
            F.struct(F.lit(r.version).alias("rule_version"), F.when(~F.array_contains("done", r.version), F.flatten(F.array(*(_hits(F.col("text"), rule) for rule in r.rules)))).alias("hits"))
            for r in rule_sets
        )
    )
    rows = pending.select("blob", F.inline(sets)).where("hits is not null").select("blob", "rule_version", F.explode_outer("hits").alias("hit"))
    rows = rows.select("blob", "rule_version", "hit.*")
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), rank.alias("rank"), F.col("kind"), F.col("end"))
    return placed.groupBy("blob", "rule_version").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("findings"))


def open_ledger(df: DataFrame, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None if nothing has been written there yet."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(_LEDGER).parquet(path)


def scan(versions: DataFrame, ledger_path: str, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with ``versions (path, text)`` and return ``path, blob, spans``.

    ``spans`` is ``array<struct<start, rank, kind, end>>`` over all rule sets, in order of start, then kind. The ledger is only
    appended to; entries that two runs at once wrote twice count once.
    """
    spark = versions.sparkSession
    content = versions.select("path", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    texts = content.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = [r.version for r in rule_sets]
    known = open_ledger(versions, ledger_path)
    if known is None:
        pending = texts.withColumn("done", F.array().cast("array<string>"))
    else:
        done = known.where(F.col("rule_version").isin(wanted)).groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        pending = texts.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        pending = pending.where(F.size("done") < len(wanted))
    findings(pending, rule_sets).write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(_LEDGER).parquet(ledger_path).where(F.col("rule_version").isin(wanted) & (F.size("findings") > 0))
    # two runs at once may both have scanned a blob: one entry for each (blob, rule version) counts
    ledger = ledger.groupBy("blob", "rule_version").agg(F.first("findings").alias("findings"))
    by_blob = ledger.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("spans"))
    return content.select("path", "blob").join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(_FINDINGS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(documents: DataFrame, ledger_path: str | None = None, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    ledger_path = ledger_path or shared_path(documents.sparkSession, "ledger")
    found = scan(documents.select(F.col("doc_id").alias("path"), F.col("text").cast("string").alias("text")), ledger_path, rule_sets)
    base = [r.kind for r in BASE_RULES.rules]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    only = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in base), F.sha2(_joined(only).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(documents: DataFrame, ledger_path: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mask`` (overlapping spans by one), ``n_chars`` brought up to date.

    Rows and other columns stay; a text without secrets is unchanged. Only blobs with findings are joined to texts.
    """
    columns = documents.columns
    ledger_path = ledger_path or shared_path(documents.sparkSession, "ledger")
    found = scan(documents.select(F.lit(0).alias("path"), F.col("text").cast("string").alias("text")), ledger_path)
    spans = stored(found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("_spans")), "secret-blobs")
    start = lambda s: s["start"]
    # a span opens a mask if it starts at or after the end of all before it; the reach is a running maximum
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > start(s)),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(start(s).alias("start"), s["end"].alias("end"))))),
    )
    blob, masks, new = (fresh(columns, n) for n in ("_blob", "_masks", "_text"))
    opens = F.concat(F.array(F.lit(0).cast("long")), F.transform(masks, lambda m: m["end"]))
    closes = F.concat(F.transform(masks, lambda m: m["start"]), F.array(F.length("text").cast("long")))
    kept = F.transform(F.arrays_zip(opens.alias("a"), closes.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    keyed = documents.withColumn(blob, blob_of(F.col("text")))
    joined = keyed.join(spans.select(F.col("blob").alias(blob), merged.alias(masks)), blob, "left")
    found_any = F.col(masks).isNotNull()
    cleaned = joined.withColumn(new, F.when(found_any, F.array_join(kept, mask)).otherwise(F.col("text")))
    change = {"text": F.col(new)}
    if "n_chars" in columns:
        change["n_chars"] = F.when(found_any, F.length(new).cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return cleaned.select(*(change.get(c, F.col(f"`{c}`")).alias(c) for c in columns))
