"""Text normalisation and statistics with built-in string and array functions on whole texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from opsloom.functions.ordinals import trim_ws

# Words without diagnostic value.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's
i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on
once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've
this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've
your yours yourself yourselves please kindly hello hi thanks thank regards user reported issue problem
""".split()

# Words that are never dropped.
PROTECTED_WORDS = """
server down slow error failed failure timeout deadlock crash crashed login network database router switch firewall vpn
dns dhcp ssl tls cert certificate cpu memory ram disk storage latency packet loss connection disconnected unresponsive
blocked locking
""".split()

# Word -> base form.
BASE_FORMS = {
    "failures": "failure", "servers": "server", "connections": "connection", "timeouts": "timeout",
    "routers": "router", "switches": "switch", "firewalls": "firewall", "databases": "database",
    "errors": "error", "crashes": "crash", "running": "run", "connecting": "connect", "failing": "fail",
    "disconnected": "disconnect", "deadlocks": "deadlock", "requests": "request", "interfaces": "interface",
}

# Patterns removed or replaced, and fill texts.
TAG = r"<[^>]+>"
MAIL_LINE = r"^(from|to|subject|date):.*$"
ERROR_CODE = r"\[system error code:\s*0x[0-9a-f]+\]"
NOT_WORD = r"[^\p{L}\p{N}_\s\-/.]"
NOT_PROVIDED, EMPTY_RESULT, UNKNOWN_RESULT = "Not Provided", "not provided", "unknown"
MODEL_EMPTY, MODEL_SUFFIX = "missingtext", " safetoken"
CHARS_PER_TOKEN, CHARS_PER_TOKEN_INT, TOKENS_PER_WORD, TOKEN_BUDGET = 4.5, 4, 1.3, 256

TEXT_COLUMNS = ("short_description", "description", "close_notes")


def words(c: Column) -> Column:
    """Words split at white space, no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def char_count(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, " ")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form: the one step Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc_text(c: Column) -> Column:
    """Send only texts with a non-ASCII character through Python."""
    return F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def stop_list(stop_words=STOP_WORDS, protected=PROTECTED_WORDS) -> list[str]:
    keep = set(protected)
    return [w for w in stop_words if w not in keep]


def normalize(
    c: Column, remove_stop_words: bool = True, base_forms: bool = True, unicode_form: bool = True,
    stop_words=STOP_WORDS, protected=PROTECTED_WORDS,
) -> Column:
    """Normalised text of a column; a missing or emptied text becomes 'not provided'."""
    raw = F.coalesce(c, F.lit(NOT_PROVIDED))
    text = F.lower(nfkc_text(raw) if unicode_form else raw)
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, "(?md)" + MAIL_LINE, " ")
    text = F.regexp_replace(text, ERROR_CODE, " system_error ")
    text = F.regexp_replace(text, NOT_WORD, " ")
    drop = stop_list(stop_words, protected) if remove_stop_words else []
    tokens = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(drop) if drop else w != "")
    if base_forms:
        table = F.create_map(*[F.lit(x) for pair in BASE_FORMS.items() for x in pair])
        tokens = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))
    joined = F.array_join(tokens, " ")
    return (
        F.when(raw == NOT_PROVIDED, EMPTY_RESULT)
        .when((raw == "Unknown") | (raw == ""), UNKNOWN_RESULT)
        .when(joined == "", EMPTY_RESULT)
        .otherwise(joined)
    )


def add_clean_text(df: DataFrame, columns=TEXT_COLUMNS, **options) -> DataFrame:
    return df.withColumns({f"{c}_clean": normalize(F.col(c), **options) for c in columns if c in df.columns})


def text_stats(df: DataFrame, columns=("short_description", "description")) -> DataFrame:
    out = {}
    for c in columns:
        if c in df.columns:
            out[f"{c}_word_count"] = word_count(F.col(c))
            out[f"{c}_char_count"] = char_count(F.col(c))
    return df.withColumns(out) if out else df


def tokens_by_chars(c: Column) -> Column:
    return F.length(c) / F.lit(CHARS_PER_TOKEN)


def tokens_by_chars_int(c: Column) -> Column:
    return F.floor(char_count(c) / F.lit(CHARS_PER_TOKEN_INT))


def tokens_by_words(c: Column) -> Column:
    return F.ceil(word_count(c) * F.lit(TOKENS_PER_WORD))


# Defaults of the semantic document and its layout.
SEMANTIC_DEFAULTS = {
    "short_description": "No short description",
    "description": "No detailed description",
    "category": "General",
    "subcategory": "General",
    "business_service": "Enterprise Service",
    "cmdb_ci": "General CI",
    "priority": "P3 - Moderate",
}
SEMANTIC_LAYOUT = "[Category: %s | Subcategory: %s] [Service: %s | CI: %s] [Priority: %s] %s"


def semantic_text(df: DataFrame) -> Column:
    """One document per ticket; a description that repeats the title is not doubled."""
    val = {}
    for c, default in SEMANTIC_DEFAULTS.items():
        if c not in df.columns:
            val[c] = F.lit(default)
            continue
        text = trim_ws(F.col(c).cast("string"))
        val[c] = F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), default).otherwise(text)
    title, body = val["short_description"], val["description"]
    repeats = F.lower(body).startswith(F.lower(title))
    detail = F.when(repeats & (F.length(body) > F.length(title)), body).when(
        F.lower(body) == F.lower(title), title
    ).otherwise(F.concat(title, F.lit(". "), body))
    fields = [val[c] for c in ("category", "subcategory", "business_service", "cmdb_ci", "priority")]
    return F.format_string(SEMANTIC_LAYOUT, *fields, detail)


def combined_text(df: DataFrame) -> Column:
    """Lower-cased title and description for the models, never empty."""
    part = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    text = F.lower(trim_ws(F.concat_ws(" ", part("short_description"), part("description"))))
    return F.concat(F.when(text == "", MODEL_EMPTY).otherwise(text), F.lit(MODEL_SUFFIX))
