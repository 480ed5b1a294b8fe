"""Guardrails on queries, evidence and answers, as columns over batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import content_tokens, coverage, let, sentences, strip, strip_citations, tokenize
from millrace.functions.vector import clamp01

BLOCK, WARN = 0.8, 0.45
SIMILARITY, CONFIDENCE, GROUNDEDNESS = 0.28, 0.42, 0.55
# Weights of the confidence factors.
FACTORS = {"top_score": 0.35, "groundedness": 0.3, "mean_score": 0.15, "agreement": 0.1, "coverage": 0.1}


class Rule(NamedTuple):
    group: str
    name: str
    weight: float
    pattern: str


# The detection rules. All are matched without regard to case.
RULES = (
    Rule("prompt_injection", "override_instructions", 0.9, r"\b(ignore|disregard|forget|override|discard)\b[\s\S]{0,30}\b(all\s+)?(previous|prior|above|earlier|initial|original|system)\b[\s\S]{0,20}\b(instruction|prompt|rule|direction|context|message)s?\b"),
    Rule("prompt_injection", "reveal_system_prompt", 0.85, r"\b(reveal|show|print|repeat|output|display|tell\s+me|what\s+(is|are))\b[\s\S]{0,30}\b(your|the)\b[\s\S]{0,20}\b(system\s+prompt|initial\s+instruction|hidden\s+(prompt|instruction)|prompt\s+template|rules?\s+you\s+(were|are))\b"),
    Rule("prompt_injection", "role_reassignment", 0.6, r"\b(you\s+are\s+now|from\s+now\s+on\s+you|act\s+as\s+(if\s+you\s+are\s+)?a|pretend\s+(to\s+be|you\s+are)|assume\s+the\s+role\s+of|simulate\s+being)\b"),
    Rule("prompt_injection", "fake_system_turn", 0.45, r"(^|\n)\s*(\[|<|#{1,3}\s*)?(system|assistant|user)\s*(\]|>|:)\s*"),
    Rule("prompt_injection", "delimiter_injection", 0.9, r"(<\|(im_start|im_end|endoftext|system|user|assistant)\|>|\[INST\]|\[/INST\]|<<SYS>>|###\s*instruction)"),
    Rule("prompt_injection", "instruction_suffix", 0.55, r"\b(new|updated|revised)\s+(instruction|rule|directive)s?\s*:"),
    Rule("jailbreak", "named_jailbreak", 0.9, r"\b(DAN\s+mode|do\s+anything\s+now|developer\s+mode|jailbreak|godmode|AIM\s+mode|unfiltered\s+mode)\b"),
    Rule("jailbreak", "restriction_removal", 0.85, r"\b(without|bypass|ignore|remove|disable|turn\s+off|no)\b[\s\S]{0,25}\b(restriction|filter|guardrail|safety|censor|limitation|ethical\s+guideline|content\s+polic)"),
    Rule("jailbreak", "hypothetical_bypass", 0.5, r"\b(hypothetically|in\s+a\s+fictional|for\s+educational\s+purposes\s+only|purely\s+theoretical)\b[\s\S]{0,60}\b(how\s+(to|do\s+i)|steps?\s+to|instructions?\s+for)\b"),
    Rule("jailbreak", "no_refusal", 0.75, r"\b(you\s+(must|will|have\s+to)\s+(not\s+)?(refuse|decline)|never\s+refuse|do\s+not\s+refuse|you\s+cannot\s+say\s+no)\b"),
    Rule("jailbreak", "encoded_payload", 0.8, r"\b(base64|rot13|hex\s+decode|decode\s+this)\b[\s\S]{0,40}\b(and\s+)?(execute|run|follow|obey)\b"),
    Rule("toxicity", "threat_of_violence", 0.95, r"\b(how\s+(to|do\s+i)|best\s+way\s+to|help\s+me)\b[\s\S]{0,30}\b(kill|murder|assault|poison|stab|shoot|torture)\b[\s\S]{0,20}\b(someone|people|him|her|them|a\s+person|my)\b"),
    Rule("toxicity", "weapon_synthesis", 0.95, r"\b(how\s+to\s+(make|build|synthesi[sz]e)|instructions?\s+for\s+(making|building))\b[\s\S]{0,30}\b(bomb|explosive|nerve\s+agent|bioweapon|chemical\s+weapon|ricin|sarin)\b"),
    Rule("toxicity", "self_harm", 0.9, r"\b(how\s+to|best\s+way\s+to|help\s+me)\b[\s\S]{0,25}\b(kill\s+myself|end\s+my\s+life|commit\s+suicide|hurt\s+myself)\b"),
    Rule("toxicity", "targeted_hate", 0.95, r"\b(all|every)\s+\w+\s+(people|men|women)\s+(are|should\s+be)\s+(killed|eliminated|exterminated|subhuman|vermin)\b"),
    Rule("out_of_scope", "meta_request", 0.6, r"\b(write|generate|compose|create)\s+(me\s+)?(a|an|some)\s+(poem|song|story|essay|script|code|program|function)\b"),
    Rule("out_of_scope", "self_reference", 0.7, r"\b(what\s+(model|llm|ai)\s+are\s+you|who\s+(made|built|created|trained)\s+you|what\s+is\s+your\s+(name|version))\b"),
    Rule("out_of_scope", "realtime_request", 0.65, r"\b(current|today'?s|latest|right\s+now)\s+(weather|time|date|price|stock|news|score)\b"),
)
# Of each rule words of which a text it matches has one, for a test that costs little.
NEEDED = {
    "override_instructions": "ignore disregard forget override discard",
    "reveal_system_prompt": "prompt instruction rule",
    "role_reassignment": "now act pretend assume simulat",
    "fake_system_turn": "system assistant user",
    "delimiter_injection": "<| [inst] [/inst] <<sys>> ###",
    "instruction_suffix": "instruction rule directive",
    "named_jailbreak": "mode anything jailbreak",
    "restriction_removal": "restriction filter guardrail safety censor limitation ethical content",
    "hypothetical_bypass": "hypothetically fictional educational theoretical",
    "no_refusal": "refuse decline cannot",
    "encoded_payload": "base64 rot13 hex decode",
    "threat_of_violence": "kill murder assault poison stab shoot torture",
    "weapon_synthesis": "bomb explosive agent weapon ricin sarin",
    "self_harm": "myself life suicide",
    "targeted_hate": "killed eliminated exterminated subhuman vermin",
    "meta_request": "poem song story essay script code program function",
    "self_reference": "you",
    "realtime_request": "weather time date price stock news score",
}
INPUT_GUARDS = ("prompt_injection", "jailbreak", "toxicity")
# What a blocked, weak or unsure request is told.
REFUSALS = {
    "prompt_injection": "This request was blocked because it tried to override the assistant’s instructions.",
    "jailbreak": "This request was blocked because it tried to bypass safety constraints.",
    "toxicity": "This request was blocked because it asks for harmful content.",
}
REFUSAL = "This request was blocked by a safety guardrail."
# The answers that stand for an answer without evidence, and for one that is not trusted.
INSUFFICIENT = "I couldn't find enough evidence in the retrieved documents."
LOW_CONFIDENCE = "I don't have enough information."
# White space as the patterns mean it; Java's \\s is ASCII only.
WHITE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def compiled(rule: Rule) -> str:
    """The rule's pattern for the JVM: without regard to case, with white space of any kind."""
    return "(?iu)" + rule.pattern.replace(r"[\s\S]", "(?s:.)").replace(r"\s", WHITE)


def rules_of(group: str) -> list[Rule]:
    return [r for r in RULES if r.group == group]


def matches(text: Column, rule: Rule, low: Column | None = None) -> Column:
    """Whether the rule's pattern is found. Tried only on texts with one of the words it needs, or with the one letter
    (long s) that the pattern takes for an s and lower case does not. ``low``: the text in lower case."""
    low = F.lower(text) if low is None else low
    words = reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in (*NEEDED[rule.name].split(), "ſ")))
    return words & text.rlike(compiled(rule))


def _by_rule(text: Column, group: str, value: Callable[[Column, Rule], Column]) -> Column:
    """``value`` of each rule of the group that matches, in their order; the lower case is made once."""
    both = F.struct(text.alias("t"), F.lower(text).alias("l"))
    return let(both, lambda x: F.array_compact(F.array(*(F.when(matches(x["t"], r, x["l"]), value(x["t"], r)) for r in rules_of(group)))))


def rule_hits(text: Column, group: str) -> Column:
    """Names of the group's rules that match, in their order."""
    return _by_rule(text, group, lambda _, r: F.lit(r.name))


def rule_score(text: Column, group: str) -> Column:
    """The sum of the matching rules' weights, at most 1."""
    weights = _by_rule(text, group, lambda _, r: F.lit(r.weight))
    return F.least(F.lit(1.0), F.round(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w), 4))


def rule_evidence(text: Column, group: str) -> Column:
    """name: snippet (white space collapsed, 120 characters) of each rule that matches."""
    snippet = lambda t, r: F.substring(F.trim(F.regexp_replace(F.regexp_substr(t, F.lit(compiled(r))), f"{WHITE}+", " ")), 1, 120)
    return _by_rule(text, group, lambda t, r: F.concat(F.lit(f"{r.name}: "), snippet(t, r)))


def verdict(score: Column) -> Column:
    return F.when(score >= BLOCK, "block").when(score >= WARN, "warn").otherwise("pass")


def input_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a query and input guard: key, guard, position, score, verdict, evidence. A null query scores 0."""
    asked = F.coalesce(F.col(text), F.lit(""))
    guards = [F.struct(F.lit(g).alias("guard"), F.lit(i).alias("position"), rule_score(asked, g).alias("score"), rule_evidence(asked, g).alias("evidence")) for i, g in enumerate(INPUT_GUARDS)]
    rows = df.select(key, F.inline(F.array(*guards)))
    return rows.withColumn("verdict", verdict(F.col("score")))


def merge_reports(results: DataFrame, key: str) -> DataFrame:
    """key, blocked, blocked_by (the first block in the order of position; null without), refusal."""
    first = F.min_by(F.when(F.col("verdict") == "block", F.col("guard")), F.when(F.col("verdict") == "block", F.col("position")))
    merged = results.groupBy(key).agg(F.max(F.col("verdict") == "block").alias("blocked"), first.alias("blocked_by"))
    texts = F.create_map(*(F.lit(x) for pair in REFUSALS.items() for x in pair))
    return merged.withColumn("refusal", F.when(F.col("blocked"), F.coalesce(F.try_element_at(texts, F.col("blocked_by")), F.lit(REFUSAL))))


def latest_results(results: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of the results of a key and guard the latest."""
    others = [c for c in results.columns if c not in (key, "guard")]
    return results.groupBy(key, "guard").agg(F.max_by(F.struct(*others), sequence).alias("r")).select(key, "guard", "r.*")


def evidence_checks(queries: DataFrame, hits: DataFrame, agreement: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """A row a query: top_score, mean_score, chunks, coverage, and verdict and score of similarity, off_topic and verification.

    hits: key, text, parent_text, dense_score (null counts as 0). Queries without hits are in it, with zeros and a block.
    """
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("dense_score", F.lit(0.0))))
    context = tokenize(F.concat_ws(" ", "text", F.coalesce("parent_text", F.lit(""))))
    found = hits.groupBy(key).agg(
        F.max(similarity).alias("top_score"), F.avg(similarity).alias("mean_score"), F.min(similarity).alias("_low"), F.count(F.lit(1)).alias("chunks"), F.array_distinct(F.flatten(F.collect_list(context))).alias("_context")
    )  # a query's hits are a short list
    rows = queries.select(key, query).join(found, key, "left").join(agreement, key, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("top_score", "mean_score", "agreement", "_low")} | {"chunks": F.coalesce("chunks", F.lit(0)), "_context": F.coalesce("_context", F.array().cast("array<string>"))})
    rows = rows.withColumn("coverage", coverage(content_tokens(F.coalesce(F.col(query), F.lit(""))), F.col("_context")))
    hint = rule_score(F.coalesce(F.col(query), F.lit("")), "out_of_scope")
    spread = F.when(F.col("chunks") > 1, F.col("top_score") - F.col("_low")).otherwise(0.0)
    consistency = F.when(F.col("top_score") > 0, 1 - F.least(F.lit(1.0), spread / F.greatest("top_score", F.lit(1e-6)))).otherwise(0.0)
    return rows.select(
        key,
        "top_score",
        "mean_score",
        "chunks",
        "agreement",
        "coverage",
        F.when((F.col("chunks") == 0) | (F.col("top_score") < SIMILARITY), "block").otherwise("pass").alias("similarity_verdict"),
        F.least(F.lit(1.0), hint * 0.6 + (1 - F.col("coverage")) * 0.4).alias("off_topic_score"),
        F.when((hint >= 0.6) & (F.col("coverage") < 0.25), "warn").otherwise("pass").alias("off_topic_verdict"),
        (0.5 * F.col("agreement") + 0.3 * consistency + 0.2 * F.least(F.lit(1.0), F.col("chunks") / 3)).alias("verification_score"),
    ).withColumn("verification_verdict", F.when(F.col("verification_score") < 0.25, "warn").otherwise("pass"))


def groundedness(answer: Column, context: Column) -> Column:
    """The share of an answer's sentences, of three content terms or more, of whose terms three fifths are in the context tokens.

    An answer of no such sentence is judged as a whole; a blank answer or an empty context gives 0.
    """
    plain = strip_citations(answer)
    judged = F.filter(F.transform(sentences(plain), lambda s: content_tokens(s["text"])), lambda t: F.size(t) >= 3)
    good = F.filter(judged, lambda t: coverage(t, context) >= 0.6)
    whole = coverage(content_tokens(plain), context)
    blank = (F.coalesce(F.trim(answer), F.lit("")) == "") | (F.coalesce(F.size(context), F.lit(0)) <= 0)
    return F.when(blank, 0.0).when(F.size(judged) == 0, whole).otherwise(F.size(good) / F.size(judged))


def confidence(df: DataFrame) -> DataFrame:
    """``df`` (with the columns of FACTORS) with confidence (four digits), sufficient (by the unrounded sum), worst (the factor that costs most)."""
    parts = {n: w * clamp01(F.col(n)) for n, w in FACTORS.items()}
    total = reduce(Column.__add__, parts.values())
    losses = F.array(*(F.struct((F.lit(FACTORS[n]) - p).alias("loss"), F.lit(-i).alias("order"), F.lit(n).alias("factor")) for i, (n, p) in enumerate(parts.items())))
    return df.withColumns({"confidence": F.round(total, 4), "sufficient": F.round(total, 12) >= CONFIDENCE, "worst": F.array_max(losses)["factor"]})


def final_answer(answer: Column, sufficient: Column) -> Column:
    """What is given out: the answer, or the text that stands for a blank or refusing one, or for one that is not trusted."""
    status = outcome(answer, sufficient)
    return F.when(status == "insufficient_context", F.lit(INSUFFICIENT)).when(status == "low_confidence", F.lit(LOW_CONFIDENCE)).otherwise(strip(answer))


def outcome(answer: Column, sufficient: Column, refusal: str = INSUFFICIENT) -> Column:
    """insufficient_context for a blank or refusing answer, low_confidence for an insufficient one, else answered."""
    text = strip(F.coalesce(answer, F.lit("")))
    return F.when((text == "") | F.contains(text, F.lit(refusal)), "insufficient_context").when(~F.coalesce(sufficient, F.lit(False)), "low_confidence").otherwise("answered")


def unverified_confidence(grounded: Column) -> Column:
    """What an answer from other sources is given."""
    return 0.55 * clamp01(grounded)
