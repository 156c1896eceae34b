"""Roles, permissions and audit records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.codecs import escape_field, key_preview

PERMISSIONS = ["read", "write", "delete", "admin", "checkpoint"]
ROLES = {"superuser": PERMISSIONS, "read_only": ["read"]}


def effective_permissions(principals: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, permission), distinct, of principals (user_id, roles array) and roles (role, permission)."""
    held = principals.select("user_id", F.explode("roles").alias("role")).distinct()
    return held.join(roles, "role").select("user_id", "permission").distinct()


def authorize(requests: DataFrame, principals: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests (user_id, permission, ...) with ``allowed``; whoever isn't known has nothing."""
    granted = effective_permissions(principals, roles).withColumn("granted", F.lit(True))
    out = requests.join(granted, ["user_id", "permission"], "left")
    return out.withColumn("allowed", F.coalesce("granted", F.lit(False))).drop("granted")


class AccessControl:
    """Driver-side checks of definitions; the tables stay frames."""

    def __init__(self):
        self.roles: dict[str, list[str]] = {}
        self.principals: dict[str, tuple[str, list[str]]] = {}

    def define_role(self, name: str, permissions: list[str]) -> None:
        unknown = set(permissions) - set(PERMISSIONS)
        if not name or unknown:
            raise ValueError(f"bad role: {name or 'no name'} {sorted(unknown)}")
        self.roles[name] = sorted(set(permissions), key=PERMISSIONS.index)

    def add_principal(self, token: str, user_id: str, roles: list[str]) -> None:
        if not token or token in self.principals:
            raise ValueError("a token must be given and new")
        if missing := set(roles) - set(self.roles):
            raise ValueError(f"undefined roles: {sorted(missing)}")
        self.principals[token] = (user_id, sorted(set(roles)))

    def remove_principal(self, token: str) -> bool:
        return self.principals.pop(token, None) is not None

    def authenticate(self, token: str) -> str:
        if token not in self.principals:
            raise PermissionError("unknown token")
        return self.principals[token][0]

    @property
    def is_open(self) -> bool:
        """Nobody is registered yet."""
        return not self.principals

    def authorize_open(self, token: str, permission: str) -> str | None:
        """``authorize``, but anyone may do anything, namelessly, while nobody is registered."""
        return None if self.is_open else self.authorize(token, permission)

    def authorize(self, token: str, permission: str) -> str:
        if self.is_open:
            raise PermissionError("nobody is registered: authorize_open says what holds then")
        user = self.authenticate(token)
        if not any(permission in self.roles[r] for r in self.principals[token][1]):
            raise PermissionError(f"{user} may not {permission}")
        return user

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        held = spark.createDataFrame([(u, r) for u, r in self.principals.values()], "user_id string, roles array<string>")
        granted = spark.createDataFrame([(r, p) for r, ps in self.roles.items() for p in ps], "role string, permission string")
        return held, granted


def audit_line(ts: Column, outcome: Column, user: Column, action: Column, key: Column, source: Column, detail: Column) -> Column:
    """Seven tab-separated fields; the key as a hex preview."""
    fields = [outcome, user, action, key_preview(key), source, detail]
    return F.concat_ws("\t", ts.cast("string"), *[F.coalesce(escape_field(f), F.lit("-")) for f in fields])


def read_audit(spark, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    names = ["ts", "outcome", "user_id", "action", "key", "source", "detail"]
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumn("ts", F.col("ts").cast("long"))


FIELDS = "ts bigint, outcome string, user_id string, action string, key binary, source string, detail string"


class AuditLog:
    """Records are gathered on the driver and appended to a folder of text files by ``sync``; none is ever rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pending = spark, path, []

    def append(self, ts: int, outcome: str, user_id: str, action: str, key: bytes = b"", source: str = "", detail: str = "") -> None:
        self.pending.append((ts, outcome, user_id, action, key, source, detail))

    def allow(self, ts: int, user_id: str, action: str, **rest) -> None:
        self.append(ts, "allow", user_id, action, **rest)

    def deny(self, ts: int, user_id: str, action: str, **rest) -> None:
        self.append(ts, "deny", user_id, action, **rest)

    def write(self, records: DataFrame) -> None:
        """Append a frame of records, each a line."""
        line = audit_line(*[F.col(f.split()[0]) for f in FIELDS.split(", ")])
        records.select(line.alias("value")).write.mode("append").text(self.path)

    def sync(self) -> int:
        """Write what is pending; the number of records."""
        n = len(self.pending)
        if n:
            self.write(self.spark.createDataFrame(self.pending, FIELDS).coalesce(1))
            self.pending = []
        return n

    def read(self) -> DataFrame:
        return read_audit(self.spark, self.path)
