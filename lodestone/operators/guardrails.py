"""Screening and rewriting of texts: queries, documents and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_QUERY = 2000
# Phrasings of prompt injection.
INJECTION = (
    r"ignore (?:all|any|the)?\s*(?:previous|prior|above|earlier)\s+instructions",
    r"disregard (?:all|any|the)?\s*(?:previous|prior|above)\s+(?:instructions|prompts?)",
    r"forget (?:everything|all previous|your instructions)",
    r"you are now (?:a|an|in)\b",
    r"act as (?:if you are|a|an)\b",
    r"\bdeveloper mode\b",
    r"\bdo anything now\b|\bDAN\b",
    r"\bjailbreak\b",
    r"pretend (?:to be|you are)\b",
    r"reveal (?:your|the)\s+(?:system|hidden|initial)\s+prompt",
    r"(?:print|show|repeat|output)\s+(?:your|the)\s+(?:system|initial|hidden)\s+prompt",
    r"what (?:are|is) your (?:system )?instructions",
    r"override (?:your|the) (?:safety|guardrails|rules)",
    r"bypass (?:the|your) (?:safety|filter|guardrail)",
)
# Probes of SQL injection.
SQL_PROBES = (
    r";\s*(?:drop|delete|truncate|update|insert|alter|create|grant)\b", r"\bunion\s+select\b", r"--\s*$", r"/\*.*\*/",
    r"\bor\s+1\s*=\s*1\b", r"'\s*or\s*'", r"\bxp_cmdshell\b",
)
# Urls of raw addresses, with credentials, in punycode, or of risky endings.
BAD_URLS = (r"https?://\d{1,3}(?:\.\d{1,3}){3}", r"https?://[^/\s]*@", r"https?://xn--", r"https?://[^\s]*\.(?:zip|mov|exe|scr|bat)\b")
# Secrets in the order in which they are replaced, and what stands for them.
SECRETS = (
    (r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token)\b\s*[:=]\s*\S+", "[REDACTED_KEY]"),
    (r"(?i)\b(?:password|passwd|pwd)\b\s*[:=]\s*\S+", "[REDACTED_PASSWORD]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}", "[REDACTED_TOKEN]"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bAIza[0-9A-Za-z_\-]{35}\b", "[REDACTED_GOOGLE_KEY]"),
    (r"\bghp_[A-Za-z0-9]{36}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"(?mi)^\s*[A-Z][A-Z0-9_]{3,}\s*=\s*\S+", "[REDACTED_ENV_VAR]"),
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
)
# Signs that an answer tells its instructions.
LEAKS = (r"you are a postgresql \+ postgis expert", r"system prompt", r"my (?:system )?instructions are", r"as an ai (?:language )?model,? i (?:was|am) (?:instructed|configured)")
# Words that the older screen blocks.
BLOCKED = ("drop", "delete", "truncate", "alter", "insert", "update", "remove", "destroy")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """One of the patterns matches; they are one expression, so that text is worked out once however many there are."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def input_categories(query: Column) -> Column:
    """length, prompt_injection, sql_injection, malicious_url: those that hold, in this order."""
    q = F.coalesce(query, F.lit(""))
    found = (("length", F.length(q) > MAX_QUERY), ("prompt_injection", any_of(q, INJECTION)), ("sql_injection", any_of(q, SQL_PROBES)), ("malicious_url", any_of(q, BAD_URLS)))
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in found)), lambda x: x.isNotNull())


def redacted(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), SECRETS, text)


def neutralized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text without secrets and with injected instructions quoted, and with flags, the sorted signs of what was found.

    The text without secrets is worked out once, in a projection of its own, and is quoted only where an instruction
    stands in it.
    """
    held = docs.withColumn("_safe", redacted(F.col(text))).withColumn("_told", any_of(F.col("_safe"), INJECTION))
    quoted = reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", "[quoted document text: $0]"), INJECTION, F.col("_safe"))
    flags = F.array(F.when(F.col("_told"), F.lit("embedded_instruction")), F.when(F.col("_safe") != F.col(text), F.lit("secret_redacted")))
    held = held.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))
    return held.withColumn(text, F.when(F.col("_told"), quoted).otherwise(F.col("_safe"))).drop("_safe", "_told")


def output_reasons(answer: Column, n_sources: Column, found: Column) -> Column:
    """leaked_prompt, leaked_secret and no_citations: those that hold."""
    a = F.coalesce(answer, F.lit(""))
    tests = (("leaked_prompt", any_of(a, LEAKS)), ("leaked_secret", redacted(a) != a), ("no_citations", found & (F.coalesce(n_sources, F.lit(0)) == 0)))
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())


def blocked_word(text: Column, whole_words: bool = True) -> Column:
    """A word of BLOCKED stands in the text; the older form also finds it within words."""
    edge = r"\b" if whole_words else ""
    return F.coalesce(text, F.lit("")).rlike(f"(?i){edge}({'|'.join(BLOCKED)}){edge}")


# Cues of what a question wants.
MAP_CUES = (
    r"\b(show|find|display|plot|map|locate|list|where|near|nearby|around|within|closest|nearest)\b",
    r"\b(cafes?|coffee|restaurants?|museums?|hospitals?|universit(y|ies)|schools?|pharmac(y|ies)|parks?|stations?|landmarks?|mosques?|churches?|fire ?stations?|places?)\b",
    r"\b(street|district|downtown|city|area|road|square|neighbou?rhood)\b",
)
KNOWLEDGE_CUES = (
    r"\b(how many|how much|when|why|who|what (is|are|were|was)|tell me about|history|established|founded|enrol(l)?ed|students?|opening hours|hours|about|describe|"
    r"explain|information|details?|phone|contact|rating|reviews?|price|menu)\b",
)
PROXIMITY = r"\b(within\s+\d+\s*(m|meters?|metres?|km|kilomet(?:er|re)s?)|near\s+me|nearest|closest|radius|walking\s+distance|next\s+to|around\s+me)\b"
AGGREGATE = r"\b(count|number\s+of|how\s+many|sum|total|average|avg|mean|median|percentage|percent|proportion|share|distribution|breakdown|statistics|stats)\b"
GROUPED = r"\b(per|by|in\s+each|for\s+each|across|grouped?\s+by)\s+(district|governorate|category|categories|area|region|zone|neighbou?rhood|city|type|group|layer|dataset|[a-z]+)\b"
RANKED = r"\b(most|least|fewest|highest|lowest|maximum|minimum)\b"
PLAINLY_ANALYTIC = (r"\bdistribution\b", r"\b(compare|comparison|versus|vs\.?)\b", r"\b(top|bottom)\s+\d+\b", r"\bwhich\b.*\b(most|least|highest|lowest|fewest|top|bottom)\b")
EXHAUSTIVE = r"\b(how many|how much|number of|count(?:ing)?|list (?:all|every|the|out|them)|name (?:all|every)|all (?:of )?(?:the )?\w+|every\b|each\b|total)\b"
NEGATION = r"\b(do(?:es)? not|don't|doesn't|not (?:have|mention|offer|include)|without|never|no\s)\b"


def analytic(query: Column) -> Column:
    has = lambda p: query.rlike(f"(?i){p}")
    return ~has(PROXIMITY) & (any_of(query, PLAINLY_ANALYTIC) | (has(GROUPED) & (has(AGGREGATE) | has(RANKED))))


def intent(query: Column) -> tuple[Column, Column]:
    """MAP, HYBRID, KNOWLEDGE, ANALYTICS or UNKNOWN, and how sure that is."""
    q = F.coalesce(query, F.lit(""))
    count = lambda cues: reduce(lambda a, b: a + b, (q.rlike(f"(?i){c}").cast("int") for c in cues))
    places, facts = count(MAP_CUES), count(KNOWLEDGE_CUES)
    order = ((analytic(q), "ANALYTICS", 0.7), ((places >= 2) & (facts >= 1), "HYBRID", 0.6), ((places >= 1) & (facts == 0), "MAP", 0.6), ((facts >= 1) & (places <= 1), "KNOWLEDGE", 0.55), (places >= 1, "MAP", 0.5))
    kind, sure = F.lit("UNKNOWN"), F.lit(0.3)
    for test, name, p in reversed(order):
        kind, sure = F.when(test, F.lit(name)).otherwise(kind), F.when(test, F.lit(p)).otherwise(sure)
    return kind, sure


def exhaustive(query: Column) -> Column:
    """Counts, lists of all, and negations, which need every chunk."""
    has = lambda p: query.rlike(f"(?i){p}")
    return has(EXHAUSTIVE) | (has(NEGATION) & has(r"\b(which|what|list)\b"))
