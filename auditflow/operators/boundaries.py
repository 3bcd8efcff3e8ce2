"""What a file decides, by its path and, where that tells nothing, by what it imports and how it is marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import tokens
from .review import boundary

#: Kinds of syntax nodes that tell: imports, and what bears attributes, annotations or decorators.
KINDS = ("import", "use", "using", "function", "type")
#: Words that name access control as they stand, parts of names that do, and words of request trust.
ACCESS = ("auth", "authz", "authn", "login", "logout", "signin", "signout", "role", "roles", "permission", "permissions", "guard", "guards", "rbac", "acl", "jwt", "jose")
ACCESS_PARTS = ("oauth", "authentic", "authoriz", "passport", "jsonwebtoken", "bcrypt", "argon2", "pwhash", "passlib", "authlib", "flask_login", "flask_jwt_extended", "express-session", "cookie-session", "jwt-go", "casbin", "authboss", "springframework.security", "springsecurity", "javax.security", "jakarta.security", "aspnetcore.authentication", "aspnetcore.authorization", "aspnetcore.identity", "system.security", "identitymodel", "identityserver", "cryptography")
TRUST = ("cors", "csp", "helmet")


def _class(text: Column, imported: Column) -> Column:
    low = F.lower(text)
    words = tokens(text)
    within = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    strong = F.exists(F.array(*map(F.lit, ACCESS_PARTS)), lambda p: low.contains(p))
    return F.when(strong | within(ACCESS), "access-control").when(imported & within(TRUST), "request-trust")


def by_content(nodes: DataFrame) -> DataFrame:
    """(path, boundary) of files by the first of their nodes that tells one."""
    imported = F.col("kind").isin("import", "use", "using")
    text = F.when(imported, F.col("name")).otherwise(F.col("marks"))
    told = nodes.filter(text != "").select("path", "pre", _class(text, imported).alias("boundary")).filter("boundary IS NOT NULL")
    return told.groupBy("path").agg(F.min_by("boundary", "pre").alias("boundary"))


def classed(files: DataFrame, nodes: DataFrame, custom: str | None = None) -> DataFrame:
    """(path, boundary, by): the class of each file that has one, and whether its path or its content tells it."""
    c = by_content(nodes).withColumnRenamed("boundary", "_content")
    own = boundary(F.col("path"), custom)
    j = files.select("path").join(c, "path", "left").withColumns({"boundary": F.coalesce(own, "_content"), "by": F.when(own.isNotNull(), "path").otherwise("content")})
    return j.filter("boundary IS NOT NULL").select("path", "boundary", "by")
