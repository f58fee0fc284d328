"""Rule-based reading of questions and answers, as column expressions.

Order is semantics here: the first rule that matches wins. Lists of cues are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X


def first_keyword(text: Column, keywords: dict[str, list[str]], whole_words: bool = False) -> Column:
    """The first entry, in the order given, one of whose keywords occurs; null if none does.

    As substrings unless ``whole_words``: "report" then contains "port", as in the lookup this follows.
    """
    lowered, out = F.lower(text), None
    for name, words in keywords.items():
        hit = X.any_term(text, words) if whole_words else F.coalesce(lowered.rlike("|".join("\\Q" + w + "\\E" for w in words)), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def first_value(text: Column, values: list[str]) -> Column:
    """The first of the values, with its own casing, that the text contains whatever its casing."""
    lowered, out = F.lower(text), None
    for v in values:
        hit = lowered.contains(v.lower())
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


def customer_number(text: Column) -> Column:
    """The number of four digits or more after the word customer, or null."""
    return F.regexp_extract(F.lower(text), r"customer\D{0,12}([0-9]{4,18})", 1).try_cast("bigint")


def parse_question(rows: DataFrame, text: str, tables: dict[str, list[str]], statuses: dict[str, tuple[str, list[str]]], with_customer: list[str], aggregate_cue: str = "(?i)(how many|count|number of|total)") -> DataFrame:
    """``rows`` with table, method, filter_column, filter_value, read in this order of rules.

    No table: method ``none``. A status value: a count if an aggregate cue is there, else a filter.
    An aggregate cue alone: a count of all. A customer number, for tables that have the column: a
    filter by it. Otherwise ``unresolved``.
    """
    t = F.col(text)
    table = first_keyword(t, tables)
    column = value = F.lit(None).cast("string")
    for name, (status_column, values) in statuses.items():
        column = F.when(F.col("table") == name, F.lit(status_column)).otherwise(column)
        value = F.when(F.col("table") == name, first_value(t, values)).otherwise(value)
    customer = F.when(F.col("table").isin(with_customer), customer_number(t))
    aggregate = F.coalesce(t.rlike(aggregate_cue), F.lit(False))
    read = rows.withColumn("table", table).withColumn("_value", value).withColumn("_column", column).withColumn("_customer", customer)
    method = F.when(F.col("table").isNull(), "none").when(aggregate, "aggregate_count").when(F.col("_customer").isNotNull() | F.col("_value").isNotNull(), "exact_filter").otherwise("unresolved")
    by_customer = (F.col("method") == "exact_filter") & F.col("_customer").isNotNull()
    named = read.withColumn("method", method)
    return named.withColumn("filter_column", F.when(by_customer, "customer_id").when(F.col("_value").isNotNull(), F.col("_column"))).withColumn("filter_value", F.when(by_customer, F.col("_customer").cast("string")).otherwise(F.col("_value"))).drop("_value", "_column", "_customer")


#: Kinds of clauses in order of precedence and the cues of each (fixed values; case ignored).
CLAUSE_CUES = {
    "HYPOTHETICAL": r"\b(?:if|suppose|assuming|in case|once|unless)\b",
    "PERMISSION": r"\b(?:can|could|may|must|should|will) (?:i|we|a|an|the)\b|\bis it (?:possible|allowed)\b",
    "QUESTION": r"\b(?:what|which|when|where|why|how|who)\b",
    "PROCEDURE": r"\b(?:please|do not|ask for|go to|dial|reply)\b",
}


def clause_kinds(rows: DataFrame, key: str, text: str, cues: dict[str, str] | None = None) -> DataFrame:
    """(key, sentence_no, clause_no, clause, kind) of each clause.

    Sentences end at . ? ! ; and whitespace, clauses at commas and spaced dashes. The first cue that
    matches names the kind, else OTHER; once a clause is hypothetical, so is the rest of its
    sentence. Null and blank texts give no row. One sentence's clauses are one array, so the
    inheritance needs no shuffle.
    """
    cues = CLAUSE_CUES if cues is None else cues
    bare = lambda s: F.regexp_replace(F.trim(s, F.lit(" \t\r\n")), "[.?!; \t\r\n]+$", "")
    sentence = F.split(F.regexp_replace(F.col(text), "([.?!;])[ \t\r\n]+", "$1\u0001"), "\u0001", -1)
    rows = rows.select(key, F.posexplode(sentence).alias("sentence_no", "_sentence"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("_sentence", "[ \t\r\n][-–—][ \t\r\n]", ","), ",", -1), bare), lambda c: c != "")

    def kind(clause: Column) -> Column:
        out = None
        for name, pattern in cues.items():
            hit = clause.rlike("(?i)" + pattern)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out.otherwise(F.lit("OTHER"))

    rows = rows.withColumn("_clauses", parts).withColumn("_kinds", F.transform("_clauses", kind))
    first = F.array_position("_kinds", F.lit("HYPOTHETICAL"))
    inherited = F.transform("_kinds", lambda k, i: F.when((first > 0) & (i + 1 >= first), F.lit("HYPOTHETICAL")).otherwise(k))
    return rows.select(key, "sentence_no", F.posexplode(F.arrays_zip(F.col("_clauses").alias("clause"), inherited.alias("kind"))).alias("clause_no", "_c")).select(key, "sentence_no", "clause_no", F.col("_c.clause").alias("clause"), F.col("_c.kind").alias("kind"))


def gate_weight(personal: Column, relational: Column) -> Column:
    """Weight of the graph list: 0 for personal questions, 0.5 for relational ones, 0.15 else."""
    return F.when(personal, 0.0).when(relational, 0.5).otherwise(0.15)


def citations(text: Column) -> Column:
    """Distinct [F1] and [D2] marks, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([FD][0-9]+)\]"), F.lit(1)))


#: Nouns of an absence claim and the lookup that would have found their rows (fixed values).
NOUN_INTENTS = {"recharge": "recharge", "ticket": "tickets", "complaint": "tickets", "invoice": "invoice", "bill": "invoice", "subscription": "subscription", "plan": "subscription", "kyc": "kyc"}
_NO_ROWS = r"(?i)\bfound no\b|\bnone\b|\bno (?:recharges?|tickets?|complaints?|invoices?|bills?|subscriptions?|plans?|kyc_records row|kyc records?)\b"


def absence_problems(sentence: Column, passages: Column, row_counts: Column) -> Column:
    """R6 of one sentence: array<string>, empty where its claims of absence are backed.

    ``passages``: the full texts retrieved. ``row_counts``: rows found by each lookup that ran, null
    for a customer not identified. A text mentions a term of six letters or more if a word begins
    with its first five, a shorter one if it has the word. Quotes are no claims.
    """
    claim = F.lower(F.regexp_replace(F.regexp_replace(sentence, r"\[[FD][0-9]+\]", ""), '"[^"]*"', " "))
    texts = F.coalesce(passages, F.array().cast("array<string>"))
    term = F.regexp_extract(claim, r"state(?: anything)?(?: about| regarding| on)? ([a-z\-]+)", 1)
    words = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"([a-z\-]+)"), F.lit(1))))
    spoken = F.exists(words, lambda w: F.when(F.length(term) >= 6, F.startswith(w, F.left(term, F.lit(5)))).otherwise(w == term))
    silent = claim.rlike(r"\b(?:do|does)(?:n't| not) state\b")
    intents = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(claim, F.lit(n)), F.lit(i)) for n, i in NOUN_INTENTS.items()])))
    none = claim.rlike(_NO_ROWS)
    per_intent = F.array_compact(F.transform(intents, lambda i: F.when(~F.map_contains_key(row_counts, i), F.concat(F.lit("R6:not looked up:"), i)).when(F.element_at(row_counts, i) != 0, F.concat(F.lit("R6:found:"), i))))
    return F.concat(
        F.array_compact(F.array(
            F.when(silent & (term == ""), F.lit("R6:no term")).when(silent & spoken, F.concat(F.lit("R6:mentioned:"), term)),
            F.when(claim.rlike(r"\b(?:could not|couldn't|can't|cannot|can not) find\b") & (F.size(texts) > 0), F.lit("R6:passages")),
            F.when(none & row_counts.isNull(), F.lit("R6:not identified")).when(none & (F.size(intents) == 0) & ~F.exists(F.map_values(row_counts), lambda n: n == 0), F.lit("R6:no empty lookup")),
        )),
        F.when(none & row_counts.isNotNull(), per_intent).otherwise(F.array().cast("array<string>")),
    )


def groundedness(rows: DataFrame, answer: str, support: str, statuses: str | None = None, outcome: str | None = None, passages: str | None = None, row_counts: str | None = None) -> DataFrame:
    """``rows`` with ``problems`` (array<string>), empty for a grounded answer.

    ``support`` is a map from citation id to the cited text. R1: a sentence with a digit, a
    currency or one of ``statuses`` (array<string>) cites nothing; R2: an unknown id is cited; R3: a number is in no text cited by its sentence; R4: a
    ten-digit number or an e-mail address appears; R5: by ``outcome``, 'needs_identity' cites a fact
    or 'refuse_other_customer' anything, or has a digit; R6: ``absence_problems``, checked if
    ``passages`` and ``row_counts`` are named. A null answer has no problem.
    """
    bare = lambda s: F.regexp_replace(s, r"\[[FD][0-9]+\]", "")

    def sentence_problems(s: Column) -> Column:
        cited, numbers = citations(s), X.numeric_tokens(bare(s))
        known = F.flatten(F.transform(F.filter(cited, lambda c: F.map_contains_key(support, c)), lambda c: X.numeric_tokens(F.col(support)[c])))
        missing = F.array_except(numbers, known)
        factual = bare(s).rlike(r"[0-9₹$€£]")
        if statuses:
            words = F.regexp_extract_all(bare(s), F.lit(r"(\w+)"), F.lit(1))
            factual = factual | F.coalesce(F.arrays_overlap(words, F.filter(statuses, lambda w: w.rlike(r"^\p{L}{3,}$"))), F.lit(False))
        absent = absence_problems(s, F.col(passages), F.col(row_counts)) if passages and row_counts else F.array().cast("array<string>")
        return F.array_compact(F.concat(
            absent,
            F.array(F.when(factual & (F.size(cited) == 0), F.lit("R1"))),
            F.transform(F.filter(cited, lambda c: ~F.map_contains_key(support, c)), lambda c: F.concat(F.lit("R2:"), c)),
            F.transform(F.when(F.size(cited) > 0, missing).otherwise(F.array().cast("array<string>")), lambda n: F.concat(F.lit("R3:"), n)),
        ))

    whole = F.when(F.col(answer).rlike(r"(?<![0-9])[0-9]{10}(?![0-9])|[\w.+-]+@[\w-]+\.[\w.-]+"), F.lit("R4"))
    cites, of = citations(F.col(answer)), F.col(outcome) if outcome else F.lit(None).cast("string")
    outcomes = (
        F.when((of == "needs_identity") & F.exists(cites, lambda c: F.startswith(c, F.lit("F"))), F.lit("R5:fact"))
        .when((of == "refuse_other_customer") & (F.size(cites) > 0), F.lit("R5:cites")).when((of == "refuse_other_customer") & bare(F.col(answer)).rlike("[0-9]"), F.lit("R5:number"))
    )
    problems = F.concat(F.array_compact(F.array(whole, outcomes)), F.flatten(F.transform(X.sentences_simple(F.col(answer)), sentence_problems)))
    return rows.withColumn("problems", F.coalesce(F.array_distinct(problems), F.array().cast("array<string>")))
