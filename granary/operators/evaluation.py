"""Evaluation beyond plain ranks: sources with pages, unauthorised hits, parameter hashes, run history."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.access import _strings
from granary.operators.normalise import any_of

# Roles that see all pay, refusals that tell a risk, report types.
MANAGEMENT = ["hr_admin", "finance_admin", "admin", "ceo", "cfo"]
RISKS, REPORTS = ["no_permission", "cross_dept_salary"], ["finance_report", "financial_statement"]


def claimed(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """sample_id, hits, expected, recall: each of the first k rows claims the first open expectation that it matches.

    ``ranked``: sample_id, rank, path, page; ``expected``: sample_id, place, path, page (null: any
    page). An expectation of a path and page matches equal rows; one without a page any row of the
    path. The rows of a sample are k at most, so the fold is over a short array.
    """
    rows = ranked.where(F.col("rank") <= k).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "page"))).alias("rows"))
    wanted = expected.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("place", "path", "page"))).alias("wanted"))

    def step(done: Column, row: Column) -> Column:
        fits = lambda e: (e["path"] == row["path"]) & (e["page"].isNull() | F.coalesce(e["page"] == row["page"], F.lit(False))) & ~F.array_contains(done, e["place"])
        first = F.element_at(F.filter(F.col("wanted"), fits), F.lit(1))["place"]
        return F.when(F.exists(F.col("wanted"), fits), F.array_append(done, first)).otherwise(done)

    kind = expected.schema["place"].dataType.simpleString()
    both = wanted.join(rows, "sample_id", "left")
    got = F.aggregate(F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)), F.array().cast(f"array<{kind}>"), step)
    out = both.select("sample_id", F.size(got).cast("long").alias("hits"), F.size("wanted").cast("long").alias("expected"))
    return out.withColumn("recall", F.round(F.col("hits") / F.col("expected"), 9))


def unauthorised(samples: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: unauthorised hits among the samples at risk, how many there are, their share.

    ``samples``: sample_id, expected_refusal, refusal_type, user_name, data_scope, roles, department;
    ``evidence``: sample_id, doc_type, employee_name, sensitivity, doc_department.
    """
    risk = samples.where(F.coalesce("expected_refusal", F.lit(False)) & F.col("refusal_type").isin(RISKS))
    word = lambda c: F.coalesce(F.col(c), F.lit(""))
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    company, manager = word("data_scope") == "company", F.arrays_overlap(roles, _strings(MANAGEMENT))
    outside = ~company & ~manager
    kind = F.lower(word("doc_type"))
    others_pay = (kind == "salary") & (word("employee_name") != "") & (word("user_name") != "") & (word("employee_name") != word("user_name")) & outside
    other_department = (F.lower(word("sensitivity")) == "confidential") & (word("doc_department") != "") & (word("department") != "") & (word("doc_department") != word("department")) & outside
    reports = kind.isin(REPORTS) & ~F.array_contains(roles, "finance_admin") & ~company
    hits = evidence.join(risk, "sample_id").where(others_pay | other_department | reports).select("sample_id").distinct().withColumn("_hit", F.lit(1))
    out = risk.join(hits, "sample_id", "left").agg(F.count("_hit").alias("hits"), F.count("*").alias("at_risk"))
    return out.withColumn("rate", F.when(F.col("at_risk") == 0, 0.0).otherwise(F.round(F.col("hits") / F.col("at_risk"), 6)))


def params_hash(params: dict[str, Column]) -> Column:
    """Twelve hex digits of the parameters' canonical JSON: keys sorted, floats rounded to six places."""
    shown = []
    for name in sorted(params):
        # numbers as JSON shows them; all else quoted
        c = params[name]
        shown.append(F.concat(F.lit(f'"{name}": '), F.coalesce(c.cast("string"), F.lit("null"))))
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *shown), F.lit("}"))), 1, 12)


def json_number(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def json_text(c: Column) -> Column:
    safe = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")), c)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def latest_hashes(runs: DataFrame, keep: int = 500) -> DataFrame:
    """Runs (params_hash, run_at, ...) of the ``keep`` parameter hashes that ran last."""
    last = runs.groupBy("params_hash").agg(F.max("run_at").alias("_last")).orderBy(F.desc("_last"), "params_hash").limit(keep)
    return runs.join(F.broadcast(last.select("params_hash")), "params_hash", "left_semi")


def metric_ranking(aggregated: DataFrame, most: int = 10) -> DataFrame:
    """metric, experiments, place: metrics that most experiments have."""
    counted = aggregated.groupBy("metric").agg(F.countDistinct("params_hash").alias("experiments"))
    first = counted.orderBy(F.desc("experiments"), "metric").limit(most)  # a report of the first few
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("experiments"), "metric")))


def trend(runs: DataFrame, aggregated: DataFrame) -> DataFrame:
    """params_hash, last_run, metric, avg, before: each metric over the experiments in the order of their last run."""
    last = runs.groupBy("params_hash").agg(F.max("run_at").alias("last_run"))
    w = Window.partitionBy("metric").orderBy("last_run", "params_hash")
    return aggregated.join(last, "params_hash").withColumn("before", F.lag("avg").over(w)).select("params_hash", "last_run", "metric", "avg", "before")


def attribution(ranked: DataFrame, most: int = 3) -> DataFrame:
    """sample_id, hit, labels: whether any row is relevant, and the labels of the first ``most``."""
    short = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "label")))), 1, most)
    return ranked.groupBy("sample_id").agg(F.max("relevant").alias("hit"), F.array_join(F.transform(short, lambda x: x["label"].cast("string")), ",").alias("labels"))


def scope_of(user_id: Column, data_scope: Column) -> Column:
    """A sample's data scope: none without a user, ``self`` for what is no scope."""
    return F.when(F.coalesce(user_id, F.lit("")) == "", None).when(data_scope.isin("company", "department", "self"), data_scope).otherwise("self")


@dataclass(frozen=True)
class MonthlyFiles:
    """Files of one name a month, and how a text names them.

    ``file`` holds ``{}`` for the month; ``named`` and ``hinted`` are patterns with the month as
    group 1, the latter counting only beside ``topic``; ``periods`` are words (upper case) for
    several months; a text with ``title`` but no month means the months of ``usual``.
    """

    file: str
    named: str
    hinted: str
    topic: str
    title: str
    periods: dict[str, tuple[int, ...]] = field(default_factory=dict)
    usual: tuple[int, ...] = ()

    def months(self, text: Column) -> Column:
        numbers = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast("int"))
        fixed = lambda ms: F.array(*map(F.lit, ms)).cast("array<int>")
        only = lambda rule, found: F.when(rule, found).otherwise(fixed(()))
        spans = [only(F.contains(F.upper(text), F.lit(word)), fixed(ms)) for word, ms in self.periods.items()]
        every = F.concat(numbers(self.named), only(F.contains(text, F.lit(self.topic)), numbers(self.hinted)), *spans)
        valid = F.array_sort(F.array_distinct(F.filter(every, lambda m: m.between(1, 12))))
        return F.when(F.size(valid) > 0, valid).otherwise(only(F.contains(text, F.lit(self.title)), fixed(self.usual)))

    def files(self, text: Column) -> Column:
        head, _, tail = self.file.partition("{}")
        return F.transform(self.months(text), lambda m: F.concat(F.lit(head), m.cast("string"), F.lit(tail)))


def inferred_sources(question: Column, hints: Column, monthly: MonthlyFiles, named: dict[str, tuple[str, ...]]) -> Column:
    """Files that a sample's question and hints name, in order and without repeats.

    ``named``: a file and the terms of which any one names it. File names are the data set's, so
    they are parameters.
    """
    text = F.concat_ws(" ", question, hints)
    others = [F.when(any_of(text, terms), F.array(F.lit(file))).otherwise(F.array().cast("array<string>")) for file, terms in named.items()]
    return F.array_distinct(F.concat(monthly.files(text), *others))


def with_sources(samples: DataFrame, monthly: MonthlyFiles, named: dict[str, tuple[str, ...]]) -> DataFrame:
    """Samples (question, hints, expected_sources, expected_refusal) with inferred sources where none are given.

    Raises, when it is computed, on a sample that is not to be refused and has no source then.
    """
    given = F.when(F.size(F.coalesce("expected_sources", F.array().cast("array<string>"))) > 0, F.col("expected_sources")).otherwise(inferred_sources(F.col("question"), F.col("hints"), monthly, named))
    missing = (F.size(given) == 0) & ~F.coalesce("expected_refusal", F.lit(False))
    return samples.withColumn("expected_sources", F.when(missing, F.raise_error(F.concat(F.lit("a sample without source: "), F.coalesce("question", F.lit(""))))).otherwise(given))
