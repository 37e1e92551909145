"""Alerts, questionnaires and metadata: the joins that yield labels and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.predicates import answered

# Render types whose answers are choices (radio button, check box).
CHOICE_RENDER_TYPES = (4, 6)


def alert_answers(
    alerts: DataFrame,
    status: DataFrame,
    details: DataFrame,
    responses: DataFrame,
    associations: DataFrame,
    questions: DataFrame,
) -> DataFrame:
    """Every active choice answer with its alert, transaction and question.

    Filters and the needed columns are named on each side before joining, so they
    reach the scans; the lookup sides are broadcast if measured small.
    """
    a = alerts.where("IsSoftDelete = 0").select("AlertId", "EntityID", "Module", "SubModule", "AlertState")
    s = status.select(F.col("StatuslookupId").alias("AlertState"), "StatusDescription")
    d = details.select("AlertId", "SPT_RowID", "UDMTable")
    r = responses.where("IsActive = 1").select("AlertId", F.col("QuestionnaireAssID").alias("QTAID"), "ResponseText")
    t = associations.where("IsActive = 1").select(
        F.col("QuestionnaireTemplateAssociationID").alias("QTAID"), "QuestionnaireID"
    )
    q = questions.where(F.col("IsActive") == 1).where(F.col("RenderTypeID").isin(*CHOICE_RENDER_TYPES))
    q = q.select("QuestionnaireID", "QuestionnaireText", "Options", "RenderTypeID")
    asked = r.join(t, "QTAID").join(q, "QuestionnaireID").drop("QuestionnaireID")
    return a.join(s, "AlertState").drop("AlertState").join(asked, "AlertId").join(d, "AlertId")


def question_templates(questions: DataFrame, associations: DataFrame) -> DataFrame:
    """Active questions with the templates they belong to."""
    links = associations.select("QuestionnaireID", "QuestionnaireTemplateID", "QuestionnaireTemplateAssociationID")
    return questions.where(F.col("IsActive") == 1).join(links, "QuestionnaireID")


def module_metadata(modules: DataFrame, clients: DataFrame, projects: DataFrame, client: str, project: str) -> DataFrame:
    """Active modules of one client's project."""
    c = clients.where((F.col("IsActive") == 1) & (F.col("ClientUID") == client)).drop("IsActive")
    p = projects.where((F.col("IsActive") == 1) & (F.col("ProjectUID") == project)).drop("IsActive")
    return modules.where(F.col("IsActive") == 1).drop("IsActive").join(p, "RiskId").join(c, "ClientId").drop("RiskId")


def submodule_metadata(
    submodules: DataFrame, modules: DataFrame, clients: DataFrame, projects: DataFrame, client: str, project: str
) -> DataFrame:
    """Active submodules below the project's modules."""
    s = submodules.where(F.col("IsActive") == 1).drop("IsActive")
    m = module_metadata(modules, clients, projects, client, project)
    return s.join(m, "ModuleId").select("SubModuleId", "SubModuleName", "ModuleName", "ModuleId", "ProjectId", "ProjectUID")


def child_id(lookup: DataFrame, parent_name: str, child_name: str) -> DataFrame:
    """Id of a named child below a named parent (self-join on the parent id)."""
    parent = lookup.where(F.col("Name") == parent_name).select(F.col("LookupID").alias("ParentID"))
    return lookup.where(F.col("Name") == child_name).join(parent, "ParentID").select("ParentID", "LookupID")


def concern_report(alert_rows: DataFrame, transactions: DataFrame, key: str, failed: str, amount: str) -> DataFrame:
    """Distinct alert rows with their transaction's amount, failed tests first."""
    alerted = alert_rows.distinct().withColumn("ClosedAs", F.lit("Concern"))
    base = transactions.where(F.col(failed) > 0).select(key, F.col(amount).alias("Total_Concern_Amount"), failed)
    return base.join(alerted, key).orderBy(F.desc(failed), key)


def closed_answers(rows: DataFrame, module: str, submodule: str, status: str) -> DataFrame:
    return rows.where(
        (F.col("Module") == module) & (F.col("SubModule") == submodule) & (F.col("StatusDescription") == status)
    )


def training_labels(
    rows: DataFrame,
    key: str,
    question: str,
    answer: str,
    concern: Sequence[tuple[str, Sequence[str]]],
    no_concern: Sequence[tuple[str, Sequence[str]]],
) -> DataFrame:
    """``target`` 1 for keys with a concern answer, 0 for those with only a no-concern one.

    One grouped maximum: concern wins where a key has both.
    """
    target = F.when(answered(question, answer, concern), 1).when(answered(question, answer, no_concern), 0)
    labelled = rows.select(key, target.alias("target")).where(F.col("target").isNotNull())
    return labelled.groupBy(key).agg(F.max("target").alias("target"))


def training_set(labels: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Labelled rows present in the data; labels without a row are dropped."""
    return data.join(labels, key)


def labels_without_data(labels: DataFrame, data: DataFrame, key: str) -> DataFrame:
    return labels.join(data.select(key), key, "left_anti")


def live_and_archived(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows of both tables once each; columns one side lacks are null there."""
    return live.unionByName(archived, allowMissingColumns=True).distinct()


def updated_predictions(base: DataFrame, scored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values where a prediction exists, old ones elsewhere (an update by join)."""
    fresh = scored.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def described_columns(dictionary: DataFrame, described: DataFrame) -> DataFrame:
    """A fresh column list keeps the descriptions and exclusions already given."""
    known = described.select(
        "COLUMN_NAME", F.col("DESCRIPTION").alias("_description"), F.col("EXCLUDE").alias("_exclude")
    )
    joined = dictionary.join(known, "COLUMN_NAME", "left")
    return joined.select(
        *[c for c in dictionary.columns if c not in ("DESCRIPTION", "EXCLUDE")],
        F.coalesce("_description", "DESCRIPTION").alias("DESCRIPTION"),
        F.coalesce("_exclude", "EXCLUDE").alias("EXCLUDE"),
    )


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column names only one side has (schemas, not rows)."""
    rows = [(c, "deleted") for c in old.columns if c not in new.columns]
    rows += [(c, "new") for c in new.columns if c not in old.columns]
    return old.sparkSession.createDataFrame(rows, "column_name STRING, change STRING")


def union_on_common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))
