"""Version control sources: text of git commands as DataFrames (S12-S15). The commands run on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}


def git(repo: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout
    return out.splitlines()


def lines(spark: SparkSession, text: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text], "value string")


def name_status(rows: DataFrame) -> DataFrame:
    """(path, status) of 'git diff --name-status' lines; a rename counts for its new path."""
    p = F.split("value", "\t")
    letter = F.substring("value", 1, 1)
    status = F.lit("modified")
    for k, v in STATUS.items():
        status = F.when(letter == k, v).otherwise(status)
    return rows.where("value like '%\t%'").select(F.element_at(p, -1).alias("path"), status.alias("status"))


def numstat(rows: DataFrame) -> DataFrame:
    """(path, additions, deletions) of 'git diff --numstat' lines; binary files count 0."""
    p = F.split("value", "\t")
    return rows.where("value like '%\t%\t%'").select(p[2].alias("path"), F.coalesce(p[0].try_cast("int"), F.lit(0)).alias("additions"), F.coalesce(p[1].try_cast("int"), F.lit(0)).alias("deletions"))


def branch_diff(stat: DataFrame, status: DataFrame) -> DataFrame:
    """(path, status, additions, deletions); a file without a status line counts as modified."""
    return numstat(stat).join(name_status(status), "path", "left").select("path", F.coalesce("status", F.lit("modified")).alias("status"), "additions", "deletions")


def since(rows: DataFrame) -> DataFrame:
    """(path, change) since a commit: added, modified (with renames) and deleted."""
    return name_status(rows).select("path", F.when(F.col("status") == "renamed", "modified").otherwise(F.col("status")).alias("change"))


def log(rows: DataFrame) -> DataFrame:
    """(hash, author, date, message) of 'hash|author|date|message' lines; the message may hold bars."""
    p = F.split("value", r"\|", 4)
    return rows.where("value like '%|%|%|%'").select(p[0].alias("hash"), p[1].alias("author"), p[2].alias("date"), p[3].alias("message"))


def diff_since(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    return since(lines(spark, git(repo, "diff", "--name-status", commit, "HEAD")))


def commits(spark: SparkSession, repo: str, *spec: str) -> DataFrame:
    return log(lines(spark, git(repo, "log", "--format=%H|%an|%aI|%s", *spec)))


def branch_info(repo: str, default: str = "main") -> dict:
    """Current branch, commits ahead of and behind the default branch, and all local branches."""
    branches = [b.strip().lstrip("* ") for b in git(repo, "branch", "--format=%(refname:short)")]
    current = (git(repo, "rev-parse", "--abbrev-ref", "HEAD") or [""])[0]
    base = next((b for b in (default, "main", "master") if b in branches), current)
    behind, ahead = (git(repo, "rev-list", "--left-right", "--count", f"{base}...HEAD") or ["0\t0"])[0].split()
    return {"branch": current, "default": base, "ahead": int(ahead), "behind": int(behind), "branches": branches}
