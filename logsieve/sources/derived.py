"""Access-log shaped tables derived row by row from the ``events`` and ``pages`` tables.

Each request is a function of one event, so these tables grow with their input; no join or shuffle is involved.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.hashing import md5_number
from logsieve.sources.examples import example

SITE_HOST = "example.com"
PATHS = [
    "/", "/index.html", "/about", "/css/style.css", "/js/app.js?v=12", "/images/logo.png",
    "/api/v1/products?page=1", "/search?q=laptop", "/article/how-to-use-our-product", "/uploads/2024/report.pdf",
    "/static/9f86d081884c7d65.js", "/webhook/a", "/.env", "/.git/HEAD", "/backup.sql", "/config.yml", "/phpinfo.php",
    "/actuator/health", "/swagger-ui.html", "/admin", "/wp-login.php", "/nacos/v1/auth/users", "//console",
    "/abcdefgh.php", "/../../../../etc/passwd", "/?lang=../../x", "/?id=1%20union select 1", "/?id=1=1", "/list?p=/x",
    "/?/spam-1.html", "/?and/spam-2.html", f"/{SITE_HOST}/{SITE_HOST}/a", "/v1/core/cluster/x",
    "/runtime/archive/q.php",
]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (compatible; Baiduspider/2.0)",
    "python-requests/2.31", "curl/8.4.0", "Go-http-client/1.1", "undici", "-", "",
]


def _examples(*patterns: str) -> list[str]:
    """One request path for each pattern."""
    found = (example(p.replace("{host}", SITE_HOST.replace(".", r"\."))) for p in patterns)
    return [text if text.startswith("/") else f"/{text}" for text in found]


#: Plain requests, the whole rule corpus, and an example of every pattern that looks at paths or bodies.
PATHS = list(
    dict.fromkeys(
        [
            *PATHS,
            *[uri for uris in V.PAYLOADS.values() for uri in uris],
            *_examples(
                *[p for _, field, patterns in V.LABEL_RULES if field != "user_agent" for p in patterns],
                *[p for p, _ in V.REPAIR_RULES], *[p for _, p in V.AUDIT_PATTERNS], *[p for _, p in V.MISSED_PROBES],
                *V.OLD_URI_RULES, *V.NEW_URI_RULES, *V.BODY_RULES, V.AUDIT_PHP, V.SEO_SPAM_RULE,
            ),
            "/archive/notes.bat", "/files/tool.ini", "/a.php?upload",
        ]
    )
)
#: A third of all requests come from plain agents, so that paths show their effect.
USER_AGENTS = [
    *USER_AGENTS,
    *[example(p) for _, field, patterns in V.LABEL_RULES if field == "user_agent" for p in patterns],
    *[example(p) for p in (*V.OLD_UA_RULES, *V.NEW_UA_RULES)],
    *["Mozilla/5.0 (X11; Linux x86_64)"] * 40,
]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
PAGES = "page_id long, url string"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(values: list[str], index: str) -> str:
    """SQL for the entry of a fixed list at ``index`` modulo its length."""
    return f"element_at(array({', '.join(map(_quoted, values))}), CAST({index} % {len(values)} + 1 AS INT))"


def _hash(salt: str, key: str) -> str:
    """SQL for the same number as ``md5_number``."""
    return f"CAST(conv(substr(md5(concat('{salt}', CAST({key} AS STRING))), 1, 8), 16, 10) AS LONG)"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; time runs 3000 times faster, so that a minute holds several requests of a client."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    hashed = events.selectExpr(
        "event_id AS row_id",
        "user_id",
        "event_type",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS us",
        *[f"{_hash(salt, 'event_id')} AS h{salt}" for salt in ("p", "u", "s", "r")],
    )
    return hashed.selectExpr(
        "row_id",
        "concat('10.0.', user_id DIV 256, '.', user_id % 256) AS ip",
        "1704067200 + us DIV 3000000000 AS event_s",
        "CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'HEAD' ELSE 'GET' END "
        "AS method",
        f"CASE WHEN hp % 97 <> 0 THEN {_pick(PATHS, 'hp')} END AS path",
        "CASE WHEN event_type <> 'error' THEN 200 WHEN hs % 5 = 0 THEN 403 WHEN hs % 5 = 1 THEN 444 "
        "WHEN hs % 5 = 2 THEN 500 ELSE 404 END AS status",
        "hs % 20000 AS size",
        f"CASE hr % 3 WHEN 0 THEN '-' WHEN 2 THEN 'https://www.{SITE_HOST}/' END AS referer",
        f"{_pick(USER_AGENTS, 'hu')} AS user_agent",
        "CASE WHEN hr % 10 = 0 THEN 'data' ELSE 'www' END AS source",
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as log lines, with unparsable lines among them: ``(row_id, source, value)``."""
    clock = F.expr(
        "date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_s), 'dd/MMM/yyyy:HH:mm:ss')"
    )
    line = F.concat(
        F.col("ip"), F.lit(" - - ["), clock, F.lit(' +0000] "'), F.col("method"), F.lit(" "),
        F.coalesce("path", F.lit("")), F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "),
        F.col("size").cast("string"), F.lit(' "'), F.coalesce("referer", F.lit("-")), F.lit('" "'),
        F.col("user_agent"), F.lit('"'),
    )
    bad = F.concat(F.lit("garbage "), F.col("row_id").cast("string"))
    return access_log(spark, sf_dir).select(
        "row_id", "source", F.when(F.col("row_id") % 53 == 0, bad).otherwise(line).alias("value")
    )


def scored(requests: DataFrame) -> DataFrame:
    """Stand-in scores: reproducible, higher for attacks, overlapping; ``predicted`` at the default threshold."""
    noise = (md5_number("m", "row_id") % 1000) * 6 + F.col("is_attack") * 3500
    with_score = requests.withColumn("score", noise.cast("double") / F.lit(10000.0))
    return with_score.withColumn("predicted", (F.col("score") >= V.DEFAULT_THRESHOLD).cast("int"))


def predicted_class(requests: DataFrame) -> DataFrame:
    """Stand-in multiclass prediction: the right class for eight rows in ten, else normal."""
    right = md5_number("c", "row_id") % 10 < 8
    return requests.withColumn("predicted_type", F.when(right, F.col("attack_type")).otherwise("normal"))


def rule_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to test rules with: the whole rule corpus once, and every page's own path."""
    fixed = spark.createDataFrame([(name, uri) for name, uris in V.PAYLOADS.items() for uri in uris], "class string, uri string")
    pages = spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet")
    own = pages.selectExpr("'page' AS class", "concat('/', regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1)) AS uri")
    return fixed.unionByName(own)
