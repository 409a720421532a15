"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A text is a blob named by the SHA-256 of its bytes, and documents are paths to blobs.
Every distinct blob of the given versions is looked up in the ledger, only the rules whose
version the ledger does not hold for it are run on it, and the findings of all runs are
joined back to every path.

Spark finds texts of matches but not their places, so a match's start is summed up from the
pieces before it: splitting at a pattern and extracting it meet at the same matches.

Defined results: a null text is empty, and so has no finding; repeated rows and equal texts
share one blob and each get its findings; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .quality import let

FINDING = "struct<kind:string,start:bigint,end:bigint>"
BLOCK = 256


class Rule(NamedTuple):
    kind: str
    pattern: str
    version: int = 1
    #: the group whose length counts, and the characters it needs
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the base patterns, then common formats of keys
BASE_RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    # a failing match takes its whole run, in which no later one could be long enough
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"\bgh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES


def running_starts(steps: Column) -> Column:
    """Start of each match from ``steps``, an array of (gap before it, length).

    In blocks, so that the cost stays near-linear for texts with very many matches.
    """

    def length(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda s, p: s + p["gap"] + p["length"])

    def inside(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            block,
            start,
            lambda s, p: F.struct(
                (s["at"] + p["gap"] + p["length"]).alias("at"),
                F.array_append(s["out"], s["at"] + p["gap"]).alias("out"),
            ),
            lambda s: s["out"],
        )

    def over(blocks: Column) -> Column:
        bases = F.aggregate(
            blocks, F.array(F.lit(0).cast("bigint")), lambda b, x: F.array_append(b, F.element_at(b, -1) + length(x))
        )
        return let(bases, lambda b: F.flatten(F.transform(blocks, lambda x, i: inside(x, F.get(b, i)))))

    blocks = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.size(steps) - 1, F.lit(BLOCK)).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )
    return let(blocks, over)


def find(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule that are long enough, as findings."""
    empty = F.array().cast(f"array<{FINDING}>")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    weighed = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern, -1)
    steps = F.transform(
        F.arrays_zip(matches.alias("m"), weighed.alias("g"), F.slice(pieces, 1, F.size(pieces) - 1).alias("p")),
        lambda z: F.struct(
            F.length(z["p"]).cast("bigint").alias("gap"),
            F.length(z["m"]).cast("bigint").alias("length"),
            (F.length(z["g"]) >= rule.least).alias("good"),
        ),
    )

    def spans(s: Column) -> Column:
        placed = F.zip_with(
            s,
            running_starts(s),
            lambda p, at: F.when(
                p["good"], F.struct(F.lit(rule.kind).alias("kind"), at.alias("start"), (at + p["length"]).alias("end"))
            ),
        )
        return F.filter(placed, lambda p: p.isNotNull())

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), let(steps, spans)).otherwise(empty)


def blobs_of(docs: DataFrame) -> DataFrame:
    """Distinct texts: (blob, text).  Copies meet map-side first, so none is a hot key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])


def _ledger_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:  # the first run has no ledger yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def scan(docs: DataFrame, rules: list[Rule] | None = None, ledger: str | None = None) -> DataFrame:
    """Findings of every distinct text of ``docs``: (blob, findings).

    ``ledger`` names a folder that lasts between runs; it gets a row for each blob scanned
    now, with the rule versions it was scanned by.  A failed run leaves no rows there, and
    a repeated one scans nothing twice.  Without one, a fresh ledger is used.
    """
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    folder = ledger or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    schema = f"blob string, versions array<string>, findings array<{FINDING}>"
    blobs = blobs_of(docs)
    past = _ledger_rows(spark, folder, schema) if ledger else None
    if past is not None:
        seen = (
            past.groupBy("blob")
            .agg(F.flatten(F.collect_set("versions")).alias("seen"))
        )
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = [~F.array_contains("seen", rule.key) for rule in rules]
        blobs = blobs.filter(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))) > 0)
    else:
        todo = [F.lit(True)] * len(rules)
    empty = F.array().cast(f"array<{FINDING}>")
    versions = F.filter(
        F.array(*[F.when(due, F.lit(rule.key)) for due, rule in zip(todo, rules, strict=True)]), lambda v: v.isNotNull()
    )
    found = F.concat(*[F.when(due, find(F.col("text"), rule)).otherwise(empty) for due, rule in zip(todo, rules, strict=True)])
    blobs.select("blob", versions.alias("versions"), found.alias("findings")).write.mode("append").parquet(folder)
    # findings of a rule's earlier version no longer count
    current = F.array(*[F.when(F.array_contains("versions", r.key), F.lit(r.kind)) for r in rules])
    return (
        spark.read.schema(schema)
        .parquet(folder)
        .select("blob", F.filter("findings", lambda f: F.coalesce(F.array_contains(current, f["kind"]), F.lit(False))).alias("findings"))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("findings")).alias("findings"))
    )


def in_order(findings: Column, kinds: list[str]) -> Column:
    """Findings by start, then by kind as listed, as kind:start:end joined by commas."""
    ranked = F.transform(
        findings,
        lambda f: F.struct(f["start"], F.array_position(F.array(*[F.lit(k) for k in kinds]), f["kind"]), f["end"], f["kind"]),
    )
    return F.array_join(
        F.transform(F.sort_array(ranked), lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )


def scan_paths(docs: DataFrame, rules: list[Rule] | None = None, ledger: str | None = None) -> DataFrame:
    """(doc_id, findings) for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    paths = docs.select("doc_id", F.sha2(text, 256).alias("blob"))
    return paths.join(scan(docs, rules, ledger), "blob").select("doc_id", "findings")
