"""Scores as columns: signals, classes, decay, retention, importance and decisions by thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions import lexicons as L
from anamnesis.functions.text import blank_words, han_count


def signal_bonus(text: Column, signals=None) -> Column:
    """Sum of the weights of all signal groups that a text shows."""
    low, total = F.lower(text), F.lit(0)
    for weight, pattern in signals or L.SIGNALS:
        total = total + F.when(low.rlike(pattern), weight).otherwise(0)
    return total.cast("bigint")


def message_class(text: Column, classes=None) -> Column:
    """The first class whose pattern a text shows, else chitchat or unknown."""
    low = F.lower(text)
    out = F.when(F.trim(low).rlike(L.CHITCHAT), F.lit("chitchat")).otherwise(F.lit("unknown"))
    for name, pattern in reversed(classes or L.CLASSES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def exempt(cls: Column) -> Column:
    return cls.isin(L.EXEMPT)


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours between two columns of microseconds."""
    return (later - earlier) / F.lit(3.6e9)


def age_decay(hours: Column) -> Column:
    return F.when(hours > 0, -F.least(F.lit(15.0), 0.3 * hours)).otherwise(F.lit(0.0))


def complexity_text(text: Column) -> Column:
    """0 to 3: variety of words, length (Chinese counts more) and structure; 0 below 20 characters."""
    n, words = F.length(text), blank_words(text)
    variety = F.when(F.size(words) < 5, F.lit(0.5)).otherwise(F.size(F.array_distinct(words)) / F.size(words))
    length = F.least(n / 500 * (1 + 2 * han_count(text) / n), F.lit(1.0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    structure = (
        F.when(text.contains("```") | text.contains("    "), 0.5).otherwise(0.0)
        + F.when((count("- ") > 2) | (count("\\* ") > 2) | (count("1\\. ") > 2), 0.3).otherwise(0.0)
        + F.when(count("\\n") > 5, 0.2).otherwise(0.0)
    )
    return F.when(n < 20, F.lit(0.0)).otherwise(F.least(variety + length + F.least(structure, F.lit(1.0)), F.lit(3.0)))


def complexity_message(tokens: Column, entities: Column, tfidf: Column, text: Column) -> Column:
    """0 to 1: tokens, entities, term weight and code."""
    code = text.contains("```") | text.contains("def ") | text.contains("function ")
    return F.least(
        F.lit(1.0),
        F.least(F.lit(0.3), tokens / 500 * 0.3) + F.least(F.lit(0.3), entities / 10 * 0.3) + F.least(F.lit(0.2), tfidf * 0.2) + F.when(code, 0.2).otherwise(0.0),
    )


def half_life_days(cls: Column) -> Column:
    out = F.lit(L.HALF_LIFE_DAYS["unknown"])
    for name, days in L.HALF_LIFE_DAYS.items():
        out = F.when(cls == name, days).otherwise(out)
    return out


def retention_by_class(base: Column, cls: Column, hours: Column, complexity: Column, access: Column) -> Column:
    """What is left of a score after some hours; exempt classes keep all."""
    start = F.when(base <= 0, F.lit(1.0)).otherwise(base)
    life = half_life_days(cls) * (1 + 0.5 * complexity) * (1 + 0.5 * F.log1p(access))
    return F.when(exempt(cls), start).otherwise(start * F.pow(F.lit(2.0), -(F.greatest(hours, F.lit(0.0)) / 24) / life))


def recall_decay(days: Column) -> Column:
    """0.3 at least, half of the rest every 14 days; 0.3 without a time."""
    return F.when(days.isNull(), F.lit(0.3)).otherwise(0.3 + 0.7 * F.pow(F.lit(0.5), days / 14))


def half_life_hours(complexity: Column, access: Column) -> Column:
    return 12 * (1 + 0.1 * complexity) * (1 + 0.1 * F.least(access, F.lit(10)))


def retention_by_hours(hours: Column, half_life: Column) -> Column:
    return F.pow(F.lit(0.5), hours / half_life)


def lifecycle(retention: Column, tier: Column, access: Column) -> Column:
    """decay, promote or keep."""
    return (
        F.when(retention < 0.3, "decay")
        .when((tier == "working") & (retention > 0.7), "promote")
        .when((tier == "episodic") & (retention > 0.8) & (access >= 3), "promote")
        .otherwise("keep")
    )


def reinforced(stability: Column, access: Column) -> Column:
    return stability * (1 + 0.5 / F.sqrt(access + 1))


def tiered_time_decay(seconds: Column) -> Column:
    return F.when(seconds < 3600, 100).when(seconds < 21600, 80).when(seconds < 86400, 60).when(seconds < 604800, 40).otherwise(20)


def keyword_importance(text: Column, seconds: Column, user_words: str | None = None) -> Column:
    """Sum of keyword weights, faded by age, short and long texts less, with whole-number steps."""
    total = F.lit(0)
    for pattern, weight in L.IMPORTANCE:
        total = total + F.when(text.rlike(pattern), weight).otherwise(0)
    whole = lambda a, b: F.floor(a * b / F.lit(100))
    faded = whole(total, tiered_time_decay(seconds))
    sized = F.when(F.length(text) < 20, whole(faded, 80)).when(F.length(text) > 500, whole(faded, 90)).otherwise(faded)
    if user_words:
        sized = sized + F.when(text.rlike(user_words), 30).otherwise(0)
    return sized.cast("bigint")


def first_class(text: Column, classes, default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(classes):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def role_class(role: Column, text: Column, words=None) -> Column:
    """thinking, tool_result, user, or one of three assistant classes."""
    low = F.lower(text)
    decided = F.lit(False)
    for w in words or L.ROLE_DECISION_WORDS:
        decided = decided | low.contains(w)
    return (
        F.when(role == "user", "user").when(role.isin("thinking", "tool_result"), role)
        .when((role == "assistant") & decided, "assistant_decision")
        .when((role == "assistant") & F.trim(low).rlike(L.CHITCHAT), "assistant_chitchat")
        .otherwise("assistant_normal")
    )


def role_weight(cls: Column) -> Column:
    return F.when(cls.isin("user", "assistant_decision"), 0.3).when(cls.isin("thinking", "assistant_chitchat"), -0.2).otherwise(0.0)


def additive_keywords(text: Column) -> Column:
    low, total = F.lower(text), F.lit(0.0)
    for weight, words in L.KEYWORD_WEIGHTS.values():
        for w in words:
            total = total + F.when(low.contains(w), weight).otherwise(0.0)
    return total


def ten_class_weight(text: Column) -> Column:
    """Weight of the first class with a keyword in the text, 50 if none."""
    low, out = F.lower(text), F.lit(50.0)
    for _, weight, words in reversed(L.TEN_CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, float(weight)).otherwise(out)
    return out


def strategy_three(usage: Column) -> Column:
    return F.when(usage < 0.6, "none").when(usage < 0.75, "light").otherwise("aggressive")


def strategy_four(percent: Column) -> Column:
    return F.when(percent < 70, "none").when(percent < 85, "light").when(percent < 95, "medium").otherwise("heavy")


#: Cost, saving rate and least tokens of each strategy.
BENEFIT = {"light": (800, 0.12, 8000), "medium": (1600, 0.27, 6400), "heavy": (2400, 0.43, 4000)}


def net_benefit(tokens: Column, strategy: str) -> Column:
    cost, rate, _ = BENEFIT[strategy]
    return F.floor(tokens * F.lit(rate)).cast("bigint") - cost


def skill_quality(steps: Column, result: Column, document: Column) -> Column:
    return F.least(
        F.lit(1.0),
        F.when(F.size(steps) >= 2, 0.3).otherwise(0.0) + F.when(F.length(result) > 20, 0.2).otherwise(0.0)
        + F.when(F.length(document) > 200, 0.2).otherwise(0.0) + F.when(document.contains("```"), 0.15).otherwise(0.0)
        + F.when(document.contains("## "), 0.15).otherwise(0.0),
    )
