"""Secrets in source lines and environment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import entropy, lines

#: Values that are no secrets, and the least length and entropy of one.
PLACEHOLDERS = ("null", "nil", "none", "your_key_here", "short", "password", "test-password", "test_password", "dummy", "example", "changeme", "replace_me", "placeholder", "todo", "xxx", "your_secret", "your_token", "your_api_key", "insert_here", "set_me", "fixme")
NO_SECRETS = ("bearer", "rs256", "hs256", "es256", "rs512", "hs512", "es512", "sha256", "sha512", "md5", "aes", "aes256", "rsa", "hmac", "basic", "digest", "oauth", "oauth2", "true", "false")
LEAST_LENGTH, LEAST_ENTROPY = 8, 3.0
ENV_ALWAYS, ENV_BY_CONTENT = (".env", ".env.local"), (".env.development", ".env.production", ".env.staging")

#: The keys whose values are looked at; a parameter, as the list is a policy.
KEYS = ("api_key", "apikey", "secret", "token", "password", "passwd", "private_key", "access_key", "client_secret")


def literal_confidence(value: Column) -> Column:
    """HIGH, LOW, or null: how likely the value of an assignment is a secret."""
    bare = F.regexp_replace(F.trim(value), r"[,;\s]+$", "")
    quoted = F.regexp_extract(bare, r"""^(["'])(.*?)\1""", 2)
    is_quoted = bare.rlike("^[\"']")
    inner = F.when(is_quoted, quoted).otherwise(bare)
    low = F.lower(inner)
    reference = inner.rlike(r"^(\$|\{\{|<|\[)|(…|\.\.\.)$|^(process\.env|os\.environ|os\.getenv|env::|std::env|System\.getenv)") | (inner.rlike(r"^[A-Z_][A-Z0-9_]{2,}$") & F.contains(inner, F.lit("_")))
    none = reference | low.isin(*PLACEHOLDERS) | low.isin(*NO_SECRETS) | (F.octet_length(inner) < LEAST_LENGTH) | (entropy(inner) < LEAST_ENTROPY)
    slug = inner.rlike(r"^[a-z]+([-_][a-z]+)+$")
    token = inner.rlike(r"^[A-Za-z0-9+/_.=-]+$") & inner.rlike("[0-9]") & inner.rlike("[A-Za-z]") & ~F.contains(inner, F.lit("("))
    return F.when(none, None).when(slug, "LOW").when(is_quoted | token, "HIGH")


def secret_lines(files: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(path, line_start, confidence) of lines that assign a secret; keys in a URL do not count."""
    pattern = r"(?i)(?:" + "|".join(keys) + r")[\"']?\s*[:=]\s*(.+)$"
    each = files.select("path", F.posexplode(lines(F.col("content"))).alias("i", "text"))
    value = F.regexp_extract(F.col("text"), pattern, 1)
    in_url = F.col("text").rlike(r"(?i)https?://[^\s\"']*(?:" + "|".join(keys) + ")=")
    hit = each.filter((value != "") & ~in_url).withColumn("confidence", literal_confidence(value))
    return hit.filter("confidence IS NOT NULL").select("path", (F.col("i") + 1).cast("int").alias("line_start"), "confidence")


def env_files(files: DataFrame) -> DataFrame:
    """(path, confidence) of committed environment files; some names count only with a secret inside."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    each = files.filter(name.isin(*ENV_ALWAYS, *ENV_BY_CONTENT)).withColumn("always", name.isin(*ENV_ALWAYS))
    pairs = F.transform(F.filter(lines(F.col("content")), lambda x: ~x.rlike(r"^\s*(#|$)")), lambda x: F.struct(F.regexp_extract(x, r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1).alias("k"), F.regexp_extract(x, r"^[^=]*=\s*(.*)$", 1).alias("v")))
    secret = F.exists(pairs, lambda p: p["k"].rlike(r"(?i)(secret|token|passw|private_?key|api_?key|access_?key|credential)") & ~p["k"].rlike(r"^(NEXT_PUBLIC|VITE|REACT_APP|EXPO_PUBLIC)_") & (literal_confidence(p["v"]) == "HIGH"))
    marked = each.withColumn("secret", F.coalesce(secret, F.lit(False)))
    return marked.filter("always OR secret").select("path", F.when(F.col("secret"), "HIGH").otherwise("MEDIUM").alias("confidence"))
