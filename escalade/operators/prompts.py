"""Prompt sources: templated generation (P1), loading a column from a dataset (S2), first-n rows (L1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.hashing import hash32

# Fixed values that must equal the reference's prompt generator: categories with their templates (in order),
# the domain concepts, the tasks and the one error text.
CATEGORIES = ("explanation", "how_to", "comparison", "troubleshooting")
TEMPLATES = {
    "explanation": (
        "Explain {concept} in simple terms",
        "What is {concept}?",
        "Can you describe {concept}?",
        "How does {concept} work?",
    ),
    "how_to": (
        "How do I {task}?",
        "What's the best way to {task}?",
        "Show me how to {task}",
        "Steps to {task}",
    ),
    "comparison": (
        "What's the difference between {item_a} and {item_b}?",
        "Compare {item_a} vs {item_b}",
        "When should I use {item_a} instead of {item_b}?",
    ),
    "troubleshooting": (
        "I'm getting an error: {error}. How do I fix it?",
        "Why am I seeing {error}?",
        "How to debug {error}?",
    ),
}
CONCEPTS = ("list comprehension", "decorators", "generators", "context managers", "metaclasses", "async/await",
            "type hints", "dataclasses")
TASKS = ("read a CSV file", "make an HTTP request", "parse JSON", "create a virtual environment",
         "install packages with pip", "write unit tests")
ERROR_TEXT = "ImportError: No module named 'foo'"

DOMAINS = ("python",)


def _flat_templates():
    flat, offsets, lengths = [], [], []
    for c in CATEGORIES:
        offsets.append(len(flat))
        lengths.append(len(TEMPLATES[c]))
        flat.extend(TEMPLATES[c])
    return flat, offsets, lengths


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def generate_prompts(ids: DataFrame, id_col: str = "id", seed: int = 0, domain: str = "python") -> DataFrame:
    """One templated prompt per input id; every choice is a seeded portable hash of the id.

    category = h0 % 4; template = h1 % (templates in category); concept/task/item_a = h2 % size;
    item_b = (item_a + 1 + h3 % 7) % 8, so the two compared items are always distinct.
    Output: ord (the id), category, prompt.
    """
    if domain not in DOMAINS:
        raise ValueError(f"unsupported domain {domain!r}")
    flat, offsets, lengths = _flat_templates()
    i = F.col(id_col)
    cat = F.pmod(hash32(i, seed), F.lit(len(CATEGORIES))).cast("int")
    within = F.pmod(hash32(i, seed + 1), F.element_at(_lits(lengths), cat + 1)).cast("int")
    tpl = F.element_at(_lits(flat), F.element_at(_lits(offsets), cat + 1) + within + 1)
    h2, h3 = hash32(i, seed + 2), hash32(i, seed + 3)
    a_idx = F.pmod(h2, F.lit(len(CONCEPTS))).cast("int")
    b_idx = F.pmod(a_idx + 1 + F.pmod(h3, F.lit(len(CONCEPTS) - 1)), F.lit(len(CONCEPTS))).cast("int")
    concept = F.element_at(_lits(CONCEPTS), a_idx + 1)
    task = F.element_at(_lits(TASKS), F.pmod(h2, F.lit(len(TASKS))).cast("int") + 1)
    item_b = F.element_at(_lits(CONCEPTS), b_idx + 1)
    prompt = tpl
    for ph, val in (("{concept}", concept), ("{task}", task), ("{item_a}", concept), ("{item_b}", item_b),
                    ("{error}", F.lit(ERROR_TEXT))):
        prompt = F.replace(prompt, F.lit(ph), val)
    return ids.select(i.cast("bigint").alias("ord"), F.element_at(_lits(CATEGORIES), cat + 1).alias("category"),
                      prompt.alias("prompt"))


def head_n(df: DataFrame, n: int | None, order_by: list[Column | str]) -> DataFrame:
    """L1: the first ``n`` rows in ``order_by`` order; ``None`` or 0 means all rows. Every task keeps its own first ``n``; nothing
    else is moved."""
    return df.orderBy(*order_by).limit(int(n)) if n else df


def load_prompts(df: DataFrame, prompt_column: str = "question", num_samples: int | None = None,
                 order_by: str | None = None) -> DataFrame:
    """Project the prompt column of a dataset (renamed ``prompt``) with an ``ord`` key, then L1."""
    if prompt_column not in df.columns:
        raise ValueError(f"Column '{prompt_column}' not found in dataset")
    key = F.col(order_by) if order_by else F.monotonically_increasing_id()
    out = df.select(key.cast("bigint").alias("ord"), F.col(prompt_column).alias("prompt"))
    return head_n(out, num_samples, ["ord"])


def generate_prompts_n(spark, num_prompts: int = 100, seed: int = 0, domain: str = "python") -> DataFrame:
    """P1 as a standalone generator: ``num_prompts`` prompts for ids 0..n-1 (``spark.range`` is split across
    tasks, every prompt is computed where its id lives)."""
    return generate_prompts(spark.range(int(num_prompts)), "id", seed, domain)


def load_prompts_file(spark, path: str, prompt_column: str = "question", num_samples: int | None = None) -> DataFrame:
    """S1 + S2: read a prompt dataset (csv / json / jsonl / parquet) and project its prompt column, in file order
    (``ord`` from the scan position), keeping the first ``num_samples`` (0 / None = all)."""
    from escalade.sources.io import read_table
    return load_prompts(read_table(spark, path), prompt_column, num_samples)
