"""Rule coverage: what the blacklists block, old against new, and the layered verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import blacklisted, first_class, first_new_rule, first_rule, label_rules, slash_uri, text
from logsieve.operators.reports import ratio, to_rows


def label_text(flag: Column) -> Column:
    return F.when(flag == 1, "attack").otherwise("normal")


def with_uri(df: DataFrame) -> DataFrame:
    return df.withColumn("uri", slash_uri(text("path"))).withColumn("ua", text("user_agent"))


def match_first_rule(df: DataFrame, body: str | None = None) -> DataFrame:
    """Add ``blocked``, ``rule_type`` and ``matched`` of the first blocking rule."""
    requests = with_uri(df)
    position, names = first_rule(F.col("uri"), F.col("ua"), F.col("method"), text(body) if body else None)
    placed = requests.withColumn("_rule", position)
    return placed.select(
        *requests.columns,
        F.col("_rule").isNotNull().alias("blocked"),
        F.get(names, F.col("_rule"))["rule_type"].alias("rule_type"),
        F.get(names, F.col("_rule"))["matched"].alias("matched"),
    )


def match_old_new(df: DataFrame) -> DataFrame:
    requests = with_uri(df)
    return requests.withColumn("old_blocked", blacklisted(F.col("uri"), F.col("ua"), "old")).withColumn(
        "new_blocked", blacklisted(F.col("uri"), F.col("ua"), "new")
    )


def rule_coverage(matched: DataFrame) -> DataFrame:
    """Per attack class: total, blocked, rate, and the rule type that blocks most (ties by name)."""
    attacks = matched.filter(F.col("is_attack") == 1)
    by_rule = attacks.groupBy("attack_type", "rule_type").agg(F.count("*").alias("n"))
    # classes x rule types: a few dozen rows from here on
    best = F.min(F.when(F.col("rule_type").isNotNull(), F.struct(-F.col("n"), F.col("rule_type"))))
    return by_rule.groupBy("attack_type").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("rule_type").isNotNull(), F.col("n")).otherwise(0)).alias("blocked"),
        F.round(
            ratio(F.sum(F.when(F.col("rule_type").isNotNull(), F.col("n")).otherwise(0)) * 100, F.sum("n")), 6
        ).alias("rate"),
        best.getField("rule_type").alias("main_rule"),
    )


def rule_compare(matched: DataFrame) -> DataFrame:
    """TP, FN, FP, TN and the two rates for both blacklists, with the change."""
    attack = F.col("is_attack") == 1
    counters = []
    for side in ("old", "new"):
        hit = F.col(f"{side}_blocked")
        counters += [
            F.count_if(attack & hit).alias(f"{side}_tp"),
            F.count_if(attack & ~hit).alias(f"{side}_fn"),
            F.count_if(~attack & hit).alias(f"{side}_fp"),
            F.count_if(~attack & ~hit).alias(f"{side}_tn"),
        ]
    counts = matched.agg(*counters)

    def rate(side: str, top: str, other: str) -> Column:
        return ratio(F.col(f"{side}_{top}") * 100, F.col(f"{side}_{top}") + F.col(f"{side}_{other}"))

    def row(name: str, old: Column, new: Column) -> dict[str, Column]:
        old, new = old.cast("double"), new.cast("double")
        return {
            "metric": F.lit(name),
            "old_value": F.round(old, 6),
            "new_value": F.round(new, 6),
            "change": F.round(new - old, 6),
        }

    rows = [row(m, F.col(f"old_{m}"), F.col(f"new_{m}")) for m in ("tp", "fn", "fp", "tn")]
    rows.append(row("block_rate", rate("old", "tp", "fn"), rate("new", "tp", "fn")))
    rows.append(row("false_block_rate", rate("old", "fp", "tn"), rate("new", "fp", "tn")))
    return to_rows(counts, rows)


def missed_by_class(matched: DataFrame) -> DataFrame:
    """Attacks each blacklist lets through and normal requests it blocks, per class."""
    attack = F.col("is_attack") == 1
    return (
        matched.groupBy("attack_type")
        .agg(
            F.count_if(attack & ~F.col("old_blocked")).alias("old_missed"),
            F.count_if(attack & ~F.col("new_blocked")).alias("new_missed"),
            F.count_if(~attack & F.col("old_blocked")).alias("old_false_block"),
            F.count_if(~attack & F.col("new_blocked")).alias("new_false_block"),
        )
        .filter("old_missed + new_missed + old_false_block + new_false_block > 0")
    )


def missed_listing(matched: DataFrame, blocked: str, n: int) -> DataFrame:
    """First ``n`` missed attacks by row id."""
    missed = matched.filter((F.col("is_attack") == 1) & ~F.col(blocked)).orderBy("row_id").limit(n)
    return missed.select("row_id", "attack_type", "method", *_shown())


def _shown() -> list[Column]:
    return [F.substring("uri", 1, 60).alias("uri"), F.substring("ua", 1, 30).alias("ua")]


def false_block_listing(matched: DataFrame, version: str) -> DataFrame:
    """Every normal request that the ``old`` or ``new`` blacklist blocks, with the first rule that does."""
    position, names = first_rule(F.col("uri"), F.col("ua"), F.col("method")) if version == "old" else first_new_rule(F.col("uri"), F.col("ua"))
    wrong = matched.filter((F.col("is_attack") == 0) & F.col(f"{version}_blocked")).withColumn("_rule", position)
    rule = F.get(names, F.col("_rule"))
    return wrong.select("row_id", "method", *_shown(), rule["rule_type"].alias("rule_type"), rule["matched"].alias("matched"))


def corpus_coverage(corpus: DataFrame) -> DataFrame:
    """Blocked requests of a labelled corpus per class, and in total over the attack classes."""
    hit = blacklisted(F.col("uri"), F.lit(V.PROBE_USER_AGENT), "new")
    attack = ~F.col("class").isin("normal", "page")
    per_class = corpus.rollup(attack.alias("attack"), "class").agg(
        F.grouping("class").alias("_all"), F.count("*").alias("total"), F.count_if(hit).alias("blocked")
    )
    wanted = per_class.filter((F.col("_all") == 0) | F.col("attack"))
    return wanted.select(
        F.when(F.col("_all") == 1, "TOTAL ATTACK").otherwise(F.col("class")).alias("class"),
        "total",
        "blocked",
        F.round(ratio(F.col("blocked") * 100, F.col("total")), 6).alias("rate"),
    )


def corpus_missed(corpus: DataFrame) -> DataFrame:
    """Requests of the corpus that no rule blocks though they are attacks: those of the attack classes, and pages whose address
    alone a label rule names, which then stand under that rule's class."""
    named = first_class([r for r in label_rules() if r.field == "path"], F.lit(None).cast("string"))
    known = corpus.withColumn("path", F.col("uri")).withColumn("class", F.when(F.col("class") == "page", named).otherwise(F.col("class")))
    hit = blacklisted(F.col("uri"), F.lit(V.PROBE_USER_AGENT), "new")
    attacks = known.filter(F.col("class").isNotNull() & (F.col("class") != "normal"))
    return attacks.filter(~hit).groupBy("class", "uri").agg(F.count("*").alias("n"))


def layered_verdict(
    df: DataFrame, rate_limit: int = V.RATE_LIMIT_PER_MINUTE, threshold: float = V.DEFAULT_THRESHOLD
) -> DataFrame:
    """Verdict of the first layer that acts: rules, rate limit, ban, then the model, which only observes.

    Expects ``req_count_60s``, ``banned`` and ``score`` on every request.
    """
    requests = with_uri(df)
    verdict = (
        F.when(blacklisted(F.col("uri"), F.col("ua"), "new"), "rule_block")
        .when(F.col("req_count_60s") > rate_limit, "rate_limit")
        .when(F.col("banned") == 1, "banned")
        .when(F.col("score") >= threshold, "observed")
        .otherwise("pass")
    )
    return requests.withColumn("verdict", verdict)
