"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version (path, text) is content-addressed by SHA-256.  The
ledger has a row per blob: which rule versions have seen it and what they found.
A scan takes distinct blobs, subtracts what the ledger has, runs only unseen
(blob, rule version) pairs, and joins the findings back to all paths, so copies
are scanned once and a new rule version touches its own pairs alone.

Rules give leftmost non-overlapping matches.  Positions come from splitting the
text at the same pattern: what lies between matches plus the matches themselves
adds up to each start, in code points.  Cheap tests keep the costly ones from
texts that can't match.

Null text: empty, no findings.  Repeated rows: each gets the findings.  Null
paths stay.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of what counts
    group: int = 0  # what counts
    hint: str = ""  # a text without it can't match
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules, then those that the method adds.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 0, "eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
)
BASE = 3


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, kind, end) of a rule's matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(counted, F.length).alias("counted"))
    empty = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        end = start + x["1"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["2"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = F.transform(rows, lambda x: F.struct(x["gap"].alias("0"), x["size"].alias("1"), x["counted"].alias("2")))
    out = F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])
    test = text.rlike(rule.pattern)
    return F.when((text.contains(rule.hint) & test) if rule.hint else test, out).otherwise(empty)


def blobs(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, done, spans) for the pairs of blob and rule version that ``ledger`` lacks.

    versions: path, blob, text.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("seen"))
        # versions whose blob has been seen by all rules leave before their texts move
        versions = versions.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        versions = versions.withColumn("todo", wanted)
    once = versions.select("blob", "todo", "text").dropDuplicates(["blob"])
    kinds = {r.kind: k for k, r in enumerate(RULES)}
    text = F.col("text")
    none = F.array().cast(SPANS)
    parts = [F.when(F.array_contains("todo", r.key), matches(text, r, kinds.get(r.kind, len(RULES) + k))).otherwise(none) for k, r in enumerate(rules)]
    return once.select("blob", F.col("todo").alias("done"), F.concat(*parts).alias("spans"))


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) for every version, and the ledger with what was new.

    New findings are written to the shared folder once, so nothing is scanned
    again when an executor is lost after that.
    """
    spark = prepare(versions.sparkSession)
    place = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    scan(versions, ledger, rules).write.parquet(place)
    new = spark.read.parquet(place)
    ledger = new if ledger is None else ledger.select("blob", "done", "spans").unionByName(new)
    found = ledger.where(F.size("spans") > 0).select("blob", "spans")
    if ledger is not new:
        found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    back = versions.select("path", "blob").join(found, "blob", "left")
    return back.select("path", "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans")), ledger


def render(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    return found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(render(base), 256).alias("base_sha256"), render(spans).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each finding replaced by ``[SECRET]``; overlapping findings by one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (F.greatest(s["start"], acc["at"]) - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.lit("[SECRET]")).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, whole)).otherwise(text)


def _sql() -> str:
    """The same in SQL: pieces between the matches and the matches, added up."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, n, {k} AS kind, '{r.kind}' AS name, unnest(range(1, len(m) + 1)) AS j, m, g, s
  FROM (SELECT doc_id, n, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS s
        FROM docs WHERE regexp_matches(t, '{p}'))""")
    least = "CASE kind " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES)) + " END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
found AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, n, kind, name, length(g[j]) AS counted,
    list_sum(list_transform(s[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS a, length(m[j]) AS size
  FROM found),
spans AS (SELECT n, kind, name, a::BIGINT AS a, (a + size)::BIGINT AS b FROM placed WHERE counted >= {least}),
one AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < {BASE}) AS base,
    string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans
  FROM spans GROUP BY n)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN one USING (n)"""


ORACLE = _sql()
