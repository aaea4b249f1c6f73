"""Tables of a code-review history and the raw shapes they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROJECT = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("project_url", T.StringType())])
DEVELOPER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("avatar", T.StringType()),
    ]
)
PULL_REQUEST = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("project", T.StringType()),
        T.StructField("sub_project", T.StringType()),
        T.StructField("change_id", T.StringType()),
        T.StructField("change_number", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("owner_id", T.LongType()),
    ]
)
REVIEW = T.StructType([T.StructField("pr_id", T.LongType(), False), T.StructField("reviewer_id", T.LongType(), False)])
FILE_PATH = T.StructType([T.StructField("pr_id", T.LongType(), False), T.StructField("location", T.StringType())])

#: A person as exports and APIs nest it.
PERSON = "struct<accountId:string,email:string,name:string,avatar:string>"
EXPORT = f"subProject string, changeId string, changeNumber bigint, timestamp bigint, owner {PERSON}, reviewers array<{PERSON}>, filePaths array<struct<location:string>>"
GITHUB_USER = "struct<id:bigint,login:string,avatar_url:string>"
GERRIT_ACCOUNT = "struct<_account_id:bigint,name:string,email:string,avatars:array<struct<url:string>>>"
GERRIT_VOTE = "struct<_account_id:bigint,name:string,email:string,value:int>"
GERRIT_CHANGE = (
    f"id string, _number bigint, project string, created string, owner {GERRIT_ACCOUNT}, "
    f"labels map<string,struct<all:array<{GERRIT_VOTE}>>>, current_revision string, "
    f"revisions map<string,struct<files:map<string,string>>>, messages array<struct<author:{GERRIT_ACCOUNT}>>"
)

#: Why a response can't be imported.
BAD_JSON, BAD_DATE, MISSING_KEY = "bad JSON", "bad date", "missing key"


@dataclass(frozen=True)
class History:
    """The five tables. Reviews are a set of (pr_id, reviewer_id); file paths are a bag, so a path may stand twice in one pull request."""

    projects: DataFrame
    developers: DataFrame
    pull_requests: DataFrame
    reviews: DataFrame
    file_paths: DataFrame


@dataclass(frozen=True)
class Settings:
    """What a recommendation run can be told."""

    use_sub_project: bool = True
    demote_inactive: bool = False
    active_months: int = 12
