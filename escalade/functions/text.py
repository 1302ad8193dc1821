"""Text columns: whitespace tokens, word-set containment, adequacy labels, pair encoding, messages.

All built-in expressions (whole-stage codegen); no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.schemas import MAX_SEQ_LENGTH

# Unicode-aware whitespace, like Python's str.split() (plain \s misses e.g. NBSP in Java regexes).
WS = r"(?U)\s+"

# Fixed special tokens of the pair encoding.
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"


# More messages than any context window holds.
MAX_MESSAGES = 100_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Whitespace tokens without empty pieces (``str.split()``)."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), WS), lambda t: t != F.lit(""))


def token_count(x: Column | str) -> Column:
    return F.size(words(x)).cast("bigint")


def token_usage(prompt: Column | str, response: Column | str) -> Column:
    """whitespace token counts (prompt, completion, total) as a struct."""
    p, c = token_count(prompt), token_count(response)
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))


def char_length(x: Column | str) -> Column:
    """length in code points."""
    return F.length(_c(x)).cast("bigint")


def word_set(x: Column | str) -> Column:
    return F.array_distinct(words(F.lower(_c(x))))


def word_containment(a: Column | str, b: Column | str) -> Column:
    """|W(a) & W(b)| / |W(a)| over lower-cased distinct words (directional; NULL when a has no words)."""
    wa, wb = word_set(a), word_set(b)
    return F.try_divide(F.size(F.array_intersect(wa, wb)).cast("double"), F.size(wa).cast("double"))


def adequacy_label(weak: Column | str, strong: Column | str, min_chars: int = 50, threshold: float = 0.7) -> Column:
    """1 when the weak response is long enough and its words are mostly contained in the strong one."""
    w = F.coalesce(_c(weak), F.lit(""))
    sim = word_containment(w, strong)
    return (F.when(F.length(w) < min_chars, F.lit(0))
            .when(F.size(word_set(w)) == 0, F.lit(0))
            .when(sim > F.lit(threshold), F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def last_user_message(messages: Column | str) -> Column:
    """F1 on a messages array: content of the last element with role 'user' (NULL if none)."""
    users = F.filter(_c(messages), lambda m: m["role"] == F.lit("user"))
    return F.when(F.size(users) > 0, F.element_at(users, -1)["content"])


def last_user_message_flat(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                           text: str = "text") -> DataFrame:
    """F1 on one-row-per-message data: ``max_by(text, turn)`` over user turns.

    A partial aggregate (map-side combine), so a very long conversation is reduced on every partition first and
    never gathered into one task. Output: key, prompt, error ('no_user_message' when the last user turn is empty
    or missing).
    """
    last = (turns.groupBy(key)
            .agg(F.max_by(F.when(F.col(role) == "user", F.col(text)),
                          F.when(F.col(role) == "user", F.col(order))).alias("prompt")))
    return last.select(key, "prompt",
                       F.when(F.coalesce(F.length("prompt"), F.lit(0)) == 0, F.lit("no_user_message")).alias("error"))


def assemble_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                      text: str = "text", max_messages: int = MAX_MESSAGES) -> DataFrame:
    """F16: ordered ``ARRAY<STRUCT<role, content>>`` per request.

    A request's message list is bounded by the model's context window, so one array per request is the request's own data
    model; a longer one than ``max_messages`` raises. Everything that only needs a field of it (F1, P8, token counts) has a flat form.
    """
    g = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"),
                                                                     F.col(text).alias("c")))).alias("_m"))
    kept = F.when(F.size("_m") <= max_messages, F.col("_m")).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {max_messages} messages in request "), F.col(key).cast("string"))))
    return g.select(key, F.transform(kept, lambda m: F.struct(m["r"].alias("role"), m["c"].alias("content")))
                    .alias("messages"))


def encode_pair(prompt: Column | str, response: Column | str, max_length: int = MAX_SEQ_LENGTH,
                padding: str = "max_length") -> Column:
    """``[CLS] prompt [SEP] response [SEP]`` over whitespace tokens, truncated to ``max_length``.

    Truncation budget B = max_length - 3. Both fit: keep all. Else the shorter side is kept whole when it fits in
    its half (ceil(B/2) for the prompt, floor(B/2) for the response) and the other side gets the rest; otherwise
    ceil/floor halves. ``padding='max_length'`` pads with [PAD] (mask 0); ``'none'`` does not pad.
    Returns struct(tokens, attention_mask, n_prompt, n_response).
    """
    if padding not in ("max_length", "none"):
        raise ValueError(f"unknown padding {padding!r}")
    if max_length < 3:
        raise ValueError("max_length must be >= 3")
    p, r = words(prompt), words(response)
    la, lb = F.size(p), F.size(r)
    b = max_length - 3
    half_hi, half_lo = (b + 1) // 2, b // 2
    ka = (F.when(la + lb <= b, la).when(la <= half_hi, la).when(lb <= half_lo, F.lit(b) - lb)
          .otherwise(F.lit(half_hi)))
    kb = (F.when(la + lb <= b, lb).when(la <= half_hi, F.lit(b) - la).when(lb <= half_lo, lb)
          .otherwise(F.lit(half_lo)))
    used = ka + kb + 3
    toks = F.concat(F.array(F.lit(CLS)), F.slice(p, 1, ka), F.array(F.lit(SEP)), F.slice(r, 1, kb),
                    F.array(F.lit(SEP)))
    mask = F.array_repeat(F.lit(1), used)
    if padding == "max_length":
        pad = F.lit(max_length) - used
        toks = F.concat(toks, F.array_repeat(F.lit(PAD), pad))
        mask = F.concat(mask, F.array_repeat(F.lit(0), pad))
    return F.struct(toks.alias("tokens"), mask.alias("attention_mask"), ka.alias("n_prompt"), kb.alias("n_response"))


def word_set_overlap(a: Column | str, b: Column | str) -> Column:
    """Sizes of the two lower-cased word sets and of their intersection."""
    wa, wb = word_set(a), word_set(b)
    return F.struct(F.size(wa).cast("bigint").alias("n_a"), F.size(wb).cast("bigint").alias("n_b"),
                    F.size(F.array_intersect(wa, wb)).cast("bigint").alias("n_common"))
