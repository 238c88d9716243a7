"""Accounts, roles, keys and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permissions_of(members: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """JOIN-01: distinct (member, code) over members (member, role_id), grants (role_id, permission_id), permissions (permission_id, code)."""
    return members.join(grants, "role_id").join(permissions, "permission_id").select("member", "code").distinct()


def usable(revoked: str, expires: str, as_of: Column) -> Column:
    """FLT-07."""
    return ~F.col(revoked) & (F.col(expires).isNull() | (F.col(expires) > as_of))


def active(revoked: str, expires: str, as_of: Column) -> Column:
    """FLT-08."""
    return ~F.col(revoked) & (F.col(expires) > as_of)


def usable_keys(keys: DataFrame, accounts: DataFrame, account: str, as_of: Column) -> DataFrame:
    """JOIN-02: keys in force with their accounts."""
    return keys.where(usable("revoked", "expires", as_of)).join(accounts, account)


def grants_by_role(roles: DataFrame, permissions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """JOIN-03, FLT-09: each role with the permissions that its rule lets it have; roles are a handful, so they are named in the rules."""
    allowed = None
    for role, rule in rules.items():
        allowed = (F.col("role") == role) & rule if allowed is None else allowed | (F.col("role") == role) & rule
    return roles.join(permissions, allowed).select("role", "code")


def after_failure(df: DataFrame, attempts: str, locked: str, failed: Column, as_of: Column, limit: int = 5, minutes: int = 15) -> DataFrame:
    """MUT-05, FLT-20: one more failure where failed; from the limit on the account is locked for some minutes."""
    more = F.col(attempts) + 1
    lock = F.when(failed & (more >= limit), as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).otherwise(F.col(locked))
    return df.withColumn(locked, lock).withColumn(attempts, F.when(failed, more).otherwise(F.col(attempts)))


def scopes(asked: Column, owned: Column, known: Column) -> Column:
    """FLT-21, SET-03, SET-04: unknown and excess scopes, and those in force (no scope asked means all owned)."""
    granted = F.when(F.size(asked) == 0, owned).otherwise(F.array_intersect(asked, owned))
    return F.struct(F.array_sort(F.array_except(asked, known)).alias("unknown"), F.array_sort(F.array_except(asked, owned)).alias("excess"), F.array_sort(granted).alias("granted"))


def revoke(df: DataFrame, which: Column) -> DataFrame:
    """MUT-06."""
    return df.withColumn("revoked", F.col("revoked") | F.coalesce(which, F.lit(False)))


def rotate(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """MUT-09: tokens (token, family, revoked, expires) after uses (token, at), as if these came one after the other.

    The first use of a token in force spends it. Use of one that is spent, before or in this batch, is a replay and revokes its whole family; so a
    token used twice does, even at one time. Where the first use is past the token's expiry it does nothing; use of a spent one is a replay even then. Unknown tokens do nothing.
    """
    uses = used.groupBy("token").agg(F.min("at").alias("_first"), F.count("*").alias("_uses")).withColumnRenamed("token", "_token")
    in_force = F.coalesce(F.col("expires") >= F.col("_first"), F.lit(True))
    hit = tokens.join(uses, F.col("token") == F.col("_token")).select("family", "token", (F.col("revoked") | in_force).alias("counts"), (F.col("revoked") | in_force & (F.col("_uses") > 1)).alias("replay"))
    broken = hit.where("replay").select(F.col("family").alias("_broken")).distinct()
    spent = hit.where("counts").select(F.col("token").alias("_spent")).distinct()
    out = tokens.join(broken, F.col("family") == F.col("_broken"), "left").join(spent, F.col("token") == F.col("_spent"), "left")
    gone = F.col("revoked") | F.col("_broken").isNotNull() | F.col("_spent").isNotNull()
    return out.select(*(gone.alias(c) if c == "revoked" else F.col(c) for c in tokens.columns))


def stale_failed(jobs: DataFrame, status: str, updated: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """MUT-07: running jobs without news for longer become failed."""
    late = F.col(updated) < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return jobs.withColumn(status, F.when((F.col(status) == "running") & late, "failed").otherwise(F.col(status)))


def with_role(members: DataFrame, roles: DataFrame, name: str) -> DataFrame:
    """JOIN-04: members with the id of the role of that name; a name that no role has gives no rows."""
    return members.withColumn("name", F.lit(name)).join(roles.select("name", "role_id"), "name").drop("name")


#: Columns that no listing may show.
SECRETS = ("access_token", "refresh_token", "key_hash", "token_hash", "password_hash", "client_secret")


def listing(df: DataFrame) -> DataFrame:
    """PRJ-21: a table without its secrets."""
    return df.drop(*SECRETS)


def connection_for(shops: DataFrame, connections: DataFrame, platform: str) -> DataFrame:
    """JOIN-21: for each shop (shop, domain) the connection of its own domain, else of its store hash, else of any platform's row for the domain.

    connections: platform, domain, seq. Of rows with one key the last by seq counts, so shops are never multiplied."""
    own = connections.where(F.col("platform") == platform)
    last = lambda df, key, name: df.groupBy(F.col("domain").alias(key)).agg(F.max(F.struct("seq", "platform", "domain")).alias(name))
    hashed = F.nullif(F.regexp_extract("domain", r"^store-([a-z0-9]+)\.mybigcommerce\.com$", 1), F.lit(""))
    out = shops.withColumn("_hash", hashed)
    out = out.join(last(own, "_k0", "_own"), out["domain"] == F.col("_k0"), "left").join(last(own, "_k1", "_hashed"), F.col("_hash") == F.col("_k1"), "left").join(last(connections, "_k2", "_any"), out["domain"] == F.col("_k2"), "left")
    found = F.coalesce("_own", "_hashed", "_any")
    return out.select(*shops.columns, found["platform"].alias("connected_platform"), found["seq"].alias("connection_seq"))
