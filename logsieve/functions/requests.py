"""Per-request features and classifiers, all as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import contains, text

DIGITS = "0123456789"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _count_chars(value: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    if len(chars) == 1:
        return F.length(value) - F.length(F.replace(value, F.lit(chars), F.lit("")))
    members = "".join(c if c.isalnum() else f"\\{c}" for c in chars)
    return F.regexp_count(value, F.lit(f"[{members}]"))


def url_features(profile: str = "train") -> dict[str, Column]:
    path = text("path")
    length = F.length(path)
    slashes = _count_chars(path, "/")
    digits = _count_chars(path, DIGITS)
    special = _count_chars(path, V.SPECIAL_CHARS)
    and_pattern = V.AND_SERVE if profile == "serve" else V.AND_TRAIN
    floor = F.greatest(length, F.lit(1)).cast("double")
    return {
        "url_length": length,
        "num_special_chars": special,
        "num_digits": digits,
        "num_dots": _count_chars(path, "."),
        "num_slashes": slashes,
        "num_params": _count_chars(path, "&="),
        "has_and_pattern": _flag(contains(path, and_pattern)),
        "encoded_chars": _count_chars(path, "%"),
        "path_depth": slashes - _flag(path.startswith("/")),
        "digit_ratio": digits.cast("double") / floor,
        "special_char_ratio": special.cast("double") / floor,
    }


def ua_features() -> dict[str, Column]:
    agent = text("user_agent")
    return {
        "ua_length": F.length(agent),
        "is_bot_ua": _flag(contains(agent, *V.BOT_WORDS)),
        "is_legitimate_bot": _flag(contains(agent, *V.SEARCH_BOTS)),
        "is_empty_ua": _flag(agent.isin("", "-")),
    }


def request_features(profile: str = "train") -> dict[str, Column]:
    """Method, response and referer features. Serving knows no referer, so there it always counts as empty."""
    method, status = F.col("method"), F.col("status")
    code = F.lit(None).cast("int")
    for position, name in enumerate(V.METHOD_CODES):
        code = F.coalesce(F.when(method == name, F.lit(position)), code)
    empty_referer = F.lit(1) if profile == "serve" else _flag(text("referer").isin("", "-"))
    return {
        "method_code": F.coalesce(code, F.lit(len(V.METHOD_CODES))),
        "is_get": _flag(method == "GET"),
        "is_post": _flag(method == "POST"),
        "is_options": _flag(method == "OPTIONS"),
        "is_head": _flag(method == "HEAD"),
        "status_code": status,
        "is_4xx": _flag(status.between(400, 499)),
        "is_5xx": _flag(status.between(500, 599)),
        "is_444": _flag(status == 444),
        "is_404": _flag(status == 404),
        "is_403": _flag(status == 403),
        "body_size": F.col("size"),
        "is_empty_referer": empty_referer,
    }


def path_features() -> dict[str, Column]:
    path = text("path")
    return {
        "path_is_root": _flag(path.isin(V.ROOT_PATHS)),
        "is_static_file": _flag(contains(path, V.STATIC_FILE)),
        "has_hash_filename": _flag(contains(path, V.HASH_FILE)),
        "is_known_api_prefix": _flag(contains(path, V.API_PREFIX)),
    }


def first_segment(path: Column) -> Column:
    """Text between the first two slashes, or the whole path where it holds no slash."""
    parts = F.split(path, "/", 3)
    return F.coalesce(F.get(parts, 1), F.get(parts, 0))


def uri_family(uri: Column) -> Column:
    return (
        F.when(uri.isNull(), "unknown")
        .when((uri == "/") | uri.startswith("/index"), "root")
        .when(uri.startswith("/api/"), "/api/*")
        .when(uri.startswith("/uploads/"), "/uploads/*")
        .when(uri.startswith("/project/"), "/project/*")
        .when(uri.contains(".php"), "*.php")
        .when(uri.contains("%"), "encoded_url")
        .otherwise("other")
    )


def ua_family(agent: Column) -> Column:
    low = F.lower(agent)
    return (
        F.when(agent.isNull(), "unknown")
        .when(low.contains("undici"), "undici")
        .when(low.contains("mozilla"), "mozilla/browser")
        .when(low.contains("java"), "java")
        .when(low.contains("bot") | low.contains("crawl"), "bot")
        .when(low.contains("mycustomua"), "custom")
        .otherwise("other")
    )


#: Feature registry: name -> builder of the column, per profile. Users may add to it.
def scalar_features(profile: str = "train") -> dict[str, Column]:
    return {**url_features(profile), **ua_features(), **request_features(profile), **path_features()}


PROFILES: dict[str, list[str]] = {
    "v1": V.URL_FEATURES + V.UA_FEATURES + V.METHOD_FEATURES + V.RESPONSE_FEATURES + V.REFERER_FEATURES
    + V.WINDOW_FEATURES,
    "v3": V.URL_FEATURES + V.UA_FEATURES + V.METHOD_FEATURES + V.REFERER_FEATURES + V.WINDOW_FEATURES
    + V.PATH_FEATURES,
    "v4": V.URL_FEATURES + V.UA_FEATURES + V.METHOD_FEATURES + V.REFERER_FEATURES + V.PATH_FEATURES,
}
ALL_FEATURES = PROFILES["v1"] + V.PATH_FEATURES
