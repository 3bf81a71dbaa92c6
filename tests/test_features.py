import pytest
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.requests import ALL_FEATURES, PROFILES, first_segment, scalar_features, ua_family, uri_family
from logsieve.operators.features import align_features, feature_table, resolve_aliases, select_profile
from logsieve.operators.labeling import label_requests


def features_of(requests, profile="train", **row):
    df = requests(row)
    return df.select(*[c.alias(n) for n, c in scalar_features(profile).items()]).first().asDict()


def test_profile_sizes():
    assert [len(PROFILES[p]) for p in ("v1", "v3", "v4")] == [31, 28, 25] and len(ALL_FEATURES) == 35


def test_url_counts(requests):
    got = features_of(requests, path="/a/b.c?x=1&y=%27é22")
    assert (got["url_length"], got["num_slashes"], got["path_depth"]) == (19, 2, 1)
    assert (got["num_params"], got["num_digits"], got["num_dots"], got["encoded_chars"]) == (3, 5, 1, 1)
    assert got["num_special_chars"] == sum(c in V.SPECIAL_CHARS for c in "/a/b.c?x=1&y=%27é22")
    assert got["digit_ratio"] == 5 / 19


def test_empty_and_null(requests):
    got = features_of(requests, path=None, user_agent=None, referer=None, method="BREW")
    assert (got["url_length"], got["digit_ratio"], got["special_char_ratio"], got["path_depth"]) == (0, 0.0, 0.0, 0)
    assert (got["ua_length"], got["is_empty_ua"], got["is_empty_referer"], got["method_code"]) == (0, 1, 1, 6)
    assert features_of(requests, user_agent="-")["ua_length"] == 1


@pytest.mark.parametrize(
    ("path", "flags"),
    [
        ("/index.php", (1, 0, 0, 0)),
        ("/a.CSS?v=1", (0, 1, 0, 0)),
        ("/a.cssx", (0, 0, 0, 0)),
        ("/9f86d081.js", (0, 1, 1, 0)),
        ("/" + "ab12" * 8, (0, 0, 1, 0)),
        ("/v12/x", (0, 0, 0, 1)),
        ("/x/api/", (0, 0, 0, 0)),
    ],
)
def test_path_flags(requests, path, flags):
    got = features_of(requests, path=path)
    assert tuple(got[f] for f in V.PATH_FEATURES) == flags


def test_serve_profile_differs_as_documented(requests):
    row = {"path": "/a?and/b", "referer": "https://r/"}
    train, serve = features_of(requests, **row), features_of(requests, "serve", **row)
    assert {n for n in train if train[n] != serve[n]} == {"has_and_pattern", "is_empty_referer"}
    served = feature_table(label_requests(requests(row)), "serve").first()
    assert [served[f] for f in V.WINDOW_FEATURES] == [0, 0, 0]


def test_families_and_segments(spark):
    df = spark.createDataFrame(
        [("/",), ("/index.x",), ("/api/x",), ("/uploads/a",), ("/project/1",), ("/a.php",), ("/%20",), ("/z",), (None,)], "p string"
    )
    assert [r[0] for r in df.select(uri_family(F.col("p"))).collect()] == [
        "root", "root", "/api/*", "/uploads/*", "/project/*", "*.php", "encoded_url", "other", "unknown",
    ]
    agents = spark.createDataFrame([("Undici",), ("mozilla bot",), ("JAVA",), ("xCrawl",), ("MyCustomUA/1",), ("",), (None,)], "a string")
    assert [r[0] for r in agents.select(ua_family(F.col("a"))).collect()] == [
        "undici", "mozilla/browser", "java", "bot", "custom", "other", "unknown",
    ]
    paths = spark.createDataFrame([("/a/b/c",), ("plain",), ("/",), ("",)], "p string")
    assert [r[0] for r in paths.select(first_segment(F.col("p"))).collect()] == ["a", "plain", "", ""]


def test_alignment_and_aliases(spark, requests):
    df = spark.createDataFrame([("3", float("nan"), None)], "a string, b double, c int")
    assert align_features(df, ["c", "a", "b", "d"]).first().asDict() == {"c": 0.0, "a": 3.0, "b": 0.0, "d": 0.0}
    with pytest.raises(ValueError, match="d"):
        align_features(df, ["a", "d"], strict=True)
    renamed = resolve_aliases(df.withColumnRenamed("a", "uri"), ["path"])
    assert "path" in renamed.columns
    with pytest.raises(ValueError, match="available"):
        resolve_aliases(df, ["path"])


def test_user_feature_and_one_row_per_request(requests):
    labeled = label_requests(requests({"path": "/a"}, {"path": "/a", "event_s": None}))
    table = feature_table(labeled, extra={"is_short": (F.length("path") < 3).cast("int")})
    assert table.columns[-1] == "is_short" and table.count() == 2
    assert select_profile(table, "v4").columns[-25:] == PROFILES["v4"]
