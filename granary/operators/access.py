"""Row-level access decisions as one boolean and one reason expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensitivities that each role may see, and the roles that see the whole company.
LEVELS = {
    "admin": ["public", "internal", "confidential", "restricted"],
    "hr_admin": ["public", "internal", "confidential"],
    "finance_admin": ["public", "internal", "confidential"],
    "manager": ["public", "internal", "confidential"],
    "employee": ["public", "internal"],
}
COMPANY_ROLES = ["admin", "hr_admin", "finance_admin"]
DEFAULT_LEVELS = ["public", "internal"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def company_wide(roles: Column, data_scope: Column) -> Column:
    return (F.coalesce(data_scope, F.lit("")) == "company") | F.arrays_overlap(F.coalesce(roles, F.array().cast("array<string>")), _strings(COMPANY_ROLES))


def allowed_levels(roles: Column) -> Column:
    roles = F.coalesce(roles, F.array().cast("array<string>"))
    parts = [F.when(F.array_contains(roles, role), _strings(levels)).otherwise(F.array().cast("array<string>")) for role, levels in LEVELS.items()]
    found = F.array_distinct(F.concat(*parts))
    return F.when(F.size(found) > 0, found).otherwise(_strings(DEFAULT_LEVELS))


def sensitivity_of(level: Column, doc_type: Column) -> Column:
    given = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    kind = F.lower(F.trim(F.coalesce(doc_type, F.lit(""))))
    return F.when(given.isin(LEVELS["admin"]), given).when(kind.isin("salary", "finance"), "confidential").when(kind.isin("policy", "report"), "internal").otherwise("public")


def doc_type_of(doc_type: Column, path: Column) -> Column:
    given, p = F.lower(F.trim(F.coalesce(doc_type, F.lit("")))), F.lower(F.coalesce(path, F.lit("")))
    any_of = lambda *words: F.exists(_strings(list(words)), lambda w: F.contains(p, w))
    return F.when(given != "", given).when(any_of("工资", "salary", "xlsx"), "salary").when(any_of("财务", "财报", "finance"), "finance").when(any_of("制度", "规章", "手册", "知识库"), "policy").when(any_of("报告", "report"), "report").otherwise("general")


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` with allowed and reason.

    Columns of a document: doc_type, sensitivity_level, owner_id, owner_name, doc_department,
    path; of its reader: user_id, user_name, department, roles, data_scope.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    wide = company_wide(F.col("roles"), F.col("data_scope"))
    same = lambda a, b: (text(a) != "") & (text(a) == text(b))
    owner = wide | same("user_id", "owner_id") | same("user_name", "owner_name")
    department = (F.coalesce(F.col("data_scope"), F.lit("")) == "company") | (text("doc_department") == "") | same("department", "doc_department")
    kind = doc_type_of(F.col("doc_type"), F.col("path"))
    level = F.array_contains(allowed_levels(F.col("roles")), sensitivity_of(F.col("sensitivity_level"), F.col("doc_type")))
    salary = kind == "salary"
    reason = F.when(salary & ~owner, "owner").when(salary & ~wide, "ok").when(~level, "sensitivity").when(~department, "department").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")


def blocked_counts(decided: DataFrame, by: str) -> DataFrame:
    return decided.groupBy(by).agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))
