"""Questions about datasets, versions, jobs, users and models, as joins over bookkeeping tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..session import pinned

KEPT_JOBS = ("preprocess", "feature_eng")


def live(df: DataFrame) -> DataFrame:
    """Rows not marked deleted."""
    return df.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in df.columns else df


def chosen(df: DataFrame, **filters: Any) -> DataFrame:
    """Equality or membership on each filter that is not None."""
    for name, value in filters.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(col(name).isin(*value))
        elif value is not None:
            df = df.where(col(name) == F.lit(value))
    return df


def latest_version(versions: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(dataset_id, version_id) of the newest version; -1 for a listed dataset without any."""
    newest = versions.groupBy("dataset_id").agg(F.max("version_id").alias("version_id"))
    if datasets is None:
        return newest
    return datasets.select("dataset_id").join(newest, "dataset_id", "left").na.fill(-1, ["version_id"])


def visible_datasets(
    datasets: DataFrame,
    versions: DataFrame,
    project_datasets: DataFrame,
    project_users: DataFrame,
    user_id: int,
    dataset_id: int | None = None,
    completed: bool = True,
) -> DataFrame:
    """Datasets of the user's projects and public ones, with the time of their newest version.

    Members are first counted down to one row per project, so a dataset does not meet every member of its project.
    """
    mine = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    members = live(project_users).groupBy("project_id").agg(F.max(mine).alias("mine"))
    allowed = project_datasets.join(members, "project_id").where(F.col("mine") | F.col("public")).select("dataset_id")
    wanted = chosen(live(datasets), dataset_id=dataset_id, completed=True if completed else None)
    newest = versions.groupBy("dataset_id").agg(F.max("creation_time").alias("last_modified"))
    return (
        wanted.join(allowed, "dataset_id", "left_semi")
        .join(newest, "dataset_id")
        .select("dataset_id", "name", "user_id", "creation_time", "last_modified")
    )


def version_listing(
    versions: DataFrame,
    datasets: DataFrame,
    mappings: DataFrame,
    project_users: DataFrame,
    dataset_id: int | None = None,
    version_id: int | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Live versions with the dataset's name and the project of their first mapping."""
    wanted = chosen(live(versions), dataset_id=dataset_id, version_id=version_id, user_id=user_id)
    origin = (
        mappings.join(project_users.select(F.col("pk").alias("project_user_id"), "project_id"), "project_user_id")
        .groupBy("dataset_id", "version_id")
        .agg(F.min_by("project_id", "pk").alias("created_in_project"))
    )
    return (
        wanted.join(datasets.select("dataset_id", "name"), "dataset_id")
        .join(origin, ["dataset_id", "version_id"], "left")
        .select("dataset_id", "name", "version_id", "user_id", "creation_time", "created_in_project")
    )


def job_history(
    jobs: DataFrame, mappings: DataFrame, project_users: DataFrame, deleted: bool = False, **filters: Any
) -> DataFrame:
    """Jobs with the dataset version and the project member they ran for.

    Filters: job_id, dataset_id, version_id, project_id, user_id, pdvu_ids, job_status, parent_job_id,
    mlflow_runid. A version counts only beside a dataset.
    """
    known = {"job_id", "dataset_id", "version_id", "project_id", "user_id", "pdvu_ids", "job_status", "parent_job_id", "mlflow_runid"}
    if set(filters) - known:
        raise ValueError(f"unknown filter: {sorted(set(filters) - known)}")
    if filters.get("dataset_id") is None:
        filters.pop("version_id", None)
    if "pdvu_ids" in filters:
        filters["pdvu_id"] = filters.pop("pdvu_ids")
    rows = jobs if deleted else live(jobs)
    joined = rows.join(
        mappings.select(F.col("pk").alias("pdvu_id"), "dataset_id", "version_id", "project_user_id"), "pdvu_id"
    ).join(project_users.select(F.col("pk").alias("project_user_id"), "project_id", "user_id"), "project_user_id")
    return chosen(joined, **filters).drop("project_user_id")


def user_roles(users: DataFrame, personas: DataFrame, user_id: int | None = None) -> DataFrame:
    """Every live user with a role, or with NULL when there is none."""
    return chosen(live(users), user_id=user_id).join(personas.select("user_id", "role_id"), "user_id", "left")


def last_login(users: DataFrame, sessions: DataFrame, user_id: int | None = None) -> DataFrame:
    """Every user with the time of the last login."""
    times = sessions.groupBy("user_id").agg(F.max("login_time").alias("login_time"))
    return chosen(users, user_id=user_id).join(times, "user_id", "left")


def latest_session(sessions: DataFrame, user_id: int | None = None, ties: str | None = None) -> DataFrame:
    """The newest session row of each user, taken map-side so a busy user costs one row per task."""
    order = F.struct("login_time", *([col(ties)] if ties else []))
    rest = [c for c in sessions.columns if c != "user_id"]
    picked = chosen(sessions, user_id=user_id).groupBy("user_id").agg(F.max_by(F.struct(*[col(c) for c in rest]), order).alias("r"))
    return picked.select("user_id", "r.*")


def project_summary(
    projects: DataFrame, project_users: DataFrame, proj_id: int | None = None, user_id: int | None = None
) -> DataFrame:
    """Projects with their number of live members; with `user_id`, only the user's projects."""
    members = live(project_users)
    sizes = members.groupBy("project_id").agg(F.count(F.lit(1)).alias("number_of_users"))
    wanted = chosen(projects, project_id=proj_id)
    if user_id is not None:
        wanted = wanted.join(chosen(members, user_id=user_id).select("project_id"), "project_id", "left_semi")
    return wanted.join(sizes, "project_id")


def permission_names(
    role_permissions: DataFrame, permissions: DataFrame, modules: DataFrame, role_id: int | None = None
) -> DataFrame:
    """A role's permissions with module name and level."""
    named = permissions.join(modules, "module_id", "left")
    return chosen(live(role_permissions), role_id=role_id).select("role_id", "perm_id").join(named, "perm_id", "left")


def membership_diff(wanted: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, change, before, after): members added, removed or changed between two sets."""
    a = wanted.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_wanted"))
    b = current.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_current"))
    change = (
        F.when(F.col("in_current").isNull(), "added")
        .when(F.col("in_wanted").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    joined = a.join(b, list(keys), "full_outer").withColumn("change", change)
    return joined.where(F.col("change").isNotNull()).select(*keys, "change", "before", "after")


def model_listing(
    models: DataFrame, versions: DataFrame, user_id: int | None, model_id: int | None = None, version_id: int | None = None
) -> DataFrame:
    """A user's models with their live versions."""
    mine = chosen(models, user_id=user_id)
    return mine.join(chosen(live(versions), model_id=model_id, version_id=version_id).drop("is_deleted"), "model_id")


def current_mapping(mappings: DataFrame, by: Sequence[str], pk: str = "pk") -> DataFrame:
    """Flag the newest mapping of each (user, project) as current.

    The newest keys are found by a map-side maximum and matched on the unique `pk`, so no group is sorted.
    """
    newest = mappings.groupBy(*by).agg(F.max(pk).alias(pk)).select(pk, F.lit(True).alias("is_current"))
    return mappings.drop("is_current").join(newest, pk, "left").na.fill(False, ["is_current"])


def profile_pending(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest version of every live dataset that was not profiled yet."""
    rest = [c for c in versions.columns if c not in ("dataset_id", "version_id")]
    newest = (
        versions.groupBy("dataset_id")
        .agg(F.max(F.struct("version_id", *rest)).alias("v"))
        .select("dataset_id", "v.*")
        .where(~F.col("profiling_done"))
    )
    return newest.join(live(datasets).select("dataset_id"), "dataset_id", "left_semi")


def lineage(
    versions: DataFrame,
    jobs: DataFrame,
    heads: DataFrame | None = None,
    dataset_id: int | None = None,
    version_id: int | None = None,
    finished: Column | None = None,
    job_types: Sequence[str] = KEPT_JOBS,
) -> DataFrame:
    """Steps from each head version back to version 1, with the job that made each; version_id gives their order.

    Jump tables double their reach, so a chain of L versions takes log2(L) joins on the unique
    (dataset_id, version_id), and a dataset with very many versions is spread like any other. Each round
    is checkpointed, so plans stay short and a lost executor costs one round.
    """
    versions = chosen(versions, dataset_id=dataset_id)
    if heads is None:
        heads = latest_version(versions) if version_id is None else chosen(versions, version_id=version_id)
    edges = versions.where(F.col("version_id") > 1)
    jump = pinned(edges.select("dataset_id", F.col("version_id").alias("at"), F.col("prev_id").alias("to")))
    reached = pinned(
        heads.where(F.col("version_id") > 1).select(
            "dataset_id", F.col("version_id").alias("head"), F.col("version_id").alias("at")
        )
    )
    while True:
        far = reached.join(jump, ["dataset_id", "at"]).where(F.col("to") > 1).select("dataset_id", "head", F.col("to").alias("at"))
        far = pinned(far)
        if far.isEmpty():
            break
        reached = pinned(reached.unionByName(far))
        second = jump.select("dataset_id", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = pinned(jump.join(second, ["dataset_id", "to"]).select("dataset_id", "at", F.col("beyond").alias("to")))
    made = edges.select("dataset_id", "version_id", "prev_id", "job_id")
    done = jobs.where(finished) if finished is not None else jobs
    return (
        reached.withColumnRenamed("at", "version_id")
        .join(made, ["dataset_id", "version_id"])
        .join(done.where(F.col("job_type").isin(*job_types)).select("job_id", "job_type"), "job_id")
        .select("dataset_id", "head", "version_id", "prev_id", "job_id", "job_type")
    )
