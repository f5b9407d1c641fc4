"""Identity accounts: profiles from JSON, find-or-create, merging and stale accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the providers' answers keep what a profile needs (fixed values: names in their public formats).
PATHS = {
    "kakao": {"id": "$.id", "email": "$.kakao_account.email", "name": "$.kakao_account.profile.nickname", "image": "$.kakao_account.profile.profile_image_url"},
    "naver": {"id": "$.response.id", "email": "$.response.email", "name": "$.response.name", "image": "$.response.profile_image"},
}


def profile(body: Column, provider: str) -> Column:
    """``struct<user_identifier, email, name, image, error>`` of a user-info answer (X24, X25). An id is needed; naver's answer must
    also carry the result code 00. E-mail addresses are lower-cased."""
    at = {k: F.get_json_object(body, p) for k, p in PATHS[provider].items()}
    ok = F.coalesce(at["id"] != "", F.lit(False))
    error = F.when(~ok, "missingId")
    if provider == "naver":
        error = F.when(~F.coalesce(F.get_json_object(body, "$.resultcode") == "00", F.lit(False)), "badResult").otherwise(error)
    return F.struct(
        F.when(error.isNull(), at["id"]).alias("user_identifier"), F.lower(at["email"]).alias("email"), at["name"].alias("name"), at["image"].alias("image"), error.alias("error")
    )


def token(body: Column) -> Column:
    """``struct<access_token, error>`` of a token answer."""
    error = F.coalesce(F.get_json_object(body, "$.error"), F.when(F.get_json_object(body, "$.access_token").isNull(), F.lit("missingToken")))
    return F.struct(F.when(error.isNull(), F.get_json_object(body, "$.access_token")).alias("access_token"), error.alias("error"))


def new_accounts(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts to create (V3): the first profile of each identifier that has none, e-mail lower-cased."""
    first = profiles.groupBy("user_identifier").agg(F.min_by(F.struct("email", "auth_user"), "created").alias("p"))
    return first.join(accounts.select("user_identifier"), "user_identifier", "left_anti").select("user_identifier", F.lower("p.email").alias("email"), F.col("p.auth_user").alias("auth_user"))


def repointed(rows: DataFrame, pairs: DataFrame, fk: str) -> DataFrame:
    """Rows after merging users (V4): references to ``remove`` become ``keep``."""
    to = pairs.select(F.col("remove").alias("_remove"), F.col("keep").alias("_keep"))
    return rows.join(to, F.col(fk) == F.col("_remove"), "left").withColumn(fk, F.coalesce("_keep", fk)).drop("_remove", "_keep")


def stale(accounts: DataFrame, now: Column, refreshed: str = "last_refreshed_at", older_than: str = "INTERVAL 1 DAY") -> DataFrame:
    """Accounts to refresh (V6): not refreshed for a day, or never."""
    return accounts.where(F.col(refreshed).isNull() | (F.col(refreshed) < now - F.expr(older_than)))


def after_notifications(accounts: DataFrame, events: DataFrame) -> DataFrame:
    """Accounts after revocations and deletions reported by a provider (V7)."""
    gone = events.where(F.col("type").isin("consent-revoked", "account-deleted")).select("user_identifier").distinct()
    return accounts.join(gone, "user_identifier", "left_anti")
