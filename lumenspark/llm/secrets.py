"""Secret scanning through an incremental ledger of blobs, in DataFrame operations only.

Every version of every text is content-addressed: equal texts are one blob. The ledger remembers which pairs of blob
and rule version have been scanned and what they gave. A scan hashes its texts, looks for pairs that the ledger lacks,
reads one representative of each such blob, records findings first and pairs after (so that a lost run is repeated,
not forgotten), and joins findings back to every path that holds the blob. New rules, or new versions of a rule, cost a
scan of the known blobs for that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import fresh_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; one whose ``group`` has under ``least`` characters is
    dropped and not tried again. ``hint`` is a literal that every match contains, or empty."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base rules of the contract.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # runs of under 24 would be dropped
)
#: Rules for well-known formats, beyond the base.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25, "xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36, "eyJ"),
    Rule("url", 1, r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^/\s:@]{1,64}:[^/\s:@]{1,128}@", 0, 1, "://"),
)
RULES = BASE + MORE


def matches(text: Column, rule: Rule) -> Column:
    """For each match in order: the code points before it since the last one, its own, and whether it counts.

    Splitting at the pattern gives what lies between the matches, so lengths alone tell their places.
    """
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    own = found if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
    sizes, held = F.transform(found, F.length), F.transform(own, F.length)
    return F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), held.alias("held")), lambda x: F.struct(x.gap.alias("gap"), x.size.alias("size"), (x.held >= rule.least).alias("good")))


@dataclass(frozen=True)
class Ledger:
    """A folder with two tables that only grow: ``scanned`` (blob, rule) and ``findings`` (blob, rule, kind, start, stop)."""

    spark: SparkSession
    path: str
    rules: tuple[Rule, ...] = field(default=RULES)

    @classmethod
    def empty(cls, spark: SparkSession, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> Ledger:
        made = cls(spark, path or fresh_path(spark, "ledger"), rules)
        spark.createDataFrame([], "blob string, rule string").write.mode("append").parquet(f"{made.path}/scanned")
        spark.createDataFrame([], "blob string, rule string, kind string, start bigint, stop bigint").write.mode("append").parquet(f"{made.path}/findings")
        return made

    def with_rules(self, rules: tuple[Rule, ...]) -> Ledger:
        return Ledger(self.spark, self.path, rules)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema("blob string, rule string").parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        """Of the present rules; a run that was lost half way may have left some twice."""
        made = self.spark.read.schema("blob string, rule string, kind string, start bigint, stop bigint").parquet(f"{self.path}/findings")
        return made.where(F.col("rule").isin([r.id for r in self.rules])).distinct()

    def pending(self, paths: DataFrame) -> DataFrame:
        """(blob, representative, rules) for the blobs of ``paths`` (path, blob) that some rule hasn't scanned."""
        blobs = paths.groupBy("blob").agg(F.min("path").alias("representative"))
        ids = [r.id for r in self.rules]
        done = self.scanned().where(F.col("rule").isin(ids)).groupBy(F.col("blob").alias("known")).agg(F.collect_set("rule").alias("seen"))
        found = blobs.join(done, blobs.blob == done.known, "left")
        left = F.array_except(F.array(*map(F.lit, ids)), F.coalesce("seen", F.array().cast("array<string>")))
        return found.select("blob", "representative", left.alias("rules")).where(F.size("rules") > 0)

    def scan(self, texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
        """Scans what is unseen of ``texts`` and returns (path, blob) for every row of it, repeats included.

        A null text is an empty blob. Null paths are paths like any other. No rows give no rows.
        """
        content = F.coalesce(F.col(text), F.lit(""))
        rows = texts.select(F.col(path).alias("path"), content.alias("text"))
        paths = rows.select("path", F.sha2("text", 256).alias("blob"))
        todo = self.pending(paths)
        hashed = rows.withColumn("own", F.sha2("text", 256))
        # the path is part of the key: a blob with many copies is dealt with its representative only
        work = hashed.join(todo, (hashed.own == todo.blob) & hashed.path.eqNullSafe(todo.representative)).select("blob", "text", "rules")
        nothing = F.array().cast("array<struct<gap:int,size:int,good:boolean>>")
        each = []
        for rule in self.rules:
            able = F.array_contains("rules", rule.id) & (F.contains("text", F.lit(rule.hint)) if rule.hint else F.col("text").rlike(rule.pattern))
            each.append(F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.kind).alias("kind"), F.when(able, matches(F.col("text"), rule)).otherwise(nothing).alias("found")))
        per_rule = work.select("blob", F.inline(F.array(*each))).where(F.size("found") > 0)
        placed = per_rule.select("blob", "rule", "kind", F.posexplode("found").alias("at", "one")).select("blob", "rule", "kind", "at", "one.*").distinct()
        place = F.expr("sum(cast(gap as bigint) + size) over (partition by blob, rule order by at rows between unbounded preceding and current row)")
        spans = placed.withColumn("stop", place).where("good").select("blob", "rule", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")
        spans.write.mode("append").parquet(f"{self.path}/findings")
        # what was pending is asked again: nothing has been marked as scanned yet
        todo.select("blob", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")
        return paths

    def report(self, paths: DataFrame) -> DataFrame:
        """Each row of ``paths`` with ``spans``: array of (start, rank of the kind, kind, stop), in that order."""
        ranks = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)])
        one = F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "stop")
        by_blob = self.findings().groupBy(F.col("blob").alias("found")).agg(F.sort_array(F.collect_list(one)).alias("spans"))
        joined = paths.join(by_blob, paths.blob == by_blob.found, "left").drop("found")
        return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")))


def written(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")
