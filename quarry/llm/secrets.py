"""Secret scans with corpus-wide ownership frequency.

Base findings come from three fixed patterns. Beside them, every token that looks like a credential is a candidate. The hash
of each one's value, base or not, is counted over the whole corpus by distinct repositories and owners. A value that several
owners or many repositories have is an example that people copy; another looks live. The places of live candidates are added
to the findings; base findings all stay, and those that are examples are named.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle

# The base kinds, in their order, with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones never hide a longer one
KINDS = ("assign", "access", "hex", "live")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Shapes of further candidates: known prefixes, web tokens, and any long mixed token.
SHAPES = re.compile(
    r"""(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|npm_|pypi-|SG\.)[A-Za-z0-9_.-]{16,}"""
    r"""|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"""
    r"""|[A-Za-z0-9+/_=-]{20,}"""
)
_KNOWN = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_live_|xox[abprs]-|AIza|ya29\.|npm_|pypi-|SG\.|eyJ")
LEAST_BITS = 3.0  # entropy a character of a token without a known prefix
MOST_OWNERS = 1  # owners of a live value
MOST_REPOS = 10  # repositories of a live value


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def base_values(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's number, value) of the base findings: what is assigned, or the whole of it."""
    return [(a, b, KINDS.index(k), ASSIGN.match(text, a)[2] if k == "assign" else text[a:b]) for a, b, k in base]


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_secret(value: str) -> bool:
    """Known prefixes always; else letters of both cases and digits, mixed well."""
    if _KNOWN.match(value):
        return True
    if not (any("0" <= c <= "9" for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)):
        return False
    return _entropy(value) >= LEAST_BITS


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of tokens like credentials that no base finding touches."""
    found, i = [], 0
    base = sorted(base)
    for m in SHAPES.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][1] <= a:
            i += 1
        if any(s < b and e > a for s, e, _ in base[max(0, i - 2) : i + 3]):
            continue
        if looks_secret(m[0]):
            found.append((a, b, m[0]))
    return found


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, repo, owner, text in zip(batch["doc_id"], batch["repo"], batch["owner"], batch["t"]):
            base = base_spans(text)
            more = candidates(text, base)
            kinds = Counter(k for _, _, k in base)
            line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
            hashes = [{"start": a, "end": b, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest()[:32]} for a, b, k, v in base_values(text, base) + [(a, b, 3, v) for a, b, v in more]]
            out.append((doc_id, repo, owner, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line.encode()).hexdigest(), line, hashes))
        yield pd.DataFrame(out, columns=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans, n_base_live, n_base_example, base_examples.

    n_live and n_example count the further candidates, n_base_live and n_base_example the base findings; base_examples has the
    places of the latter.

    Nulls: a null text has no findings; rows with a null owner are one owner, and likewise repositories. Repeated rows each
    get a row and count as one repository. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(repo_col).cast("string")), F.lit("")).alias("repo"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    schema = f"doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, more array<struct<start:int,end:int,kind:int,value:string>>"
    found = settle(texts.mapInPandas(_scan, schema)).withColumn("row", F.monotonically_increasing_id())  # stable: the rows are stored
    each = found.where(F.size("more") > 0).select("row", "repo", "owner", F.inline("more"))
    # distinct (value, repo, owner) first, then distinct within a value; both combine before the shuffle
    pairs = each.groupBy("value", "owner", "repo").agg(F.lit(1).alias("_")).drop("_")
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owned = settle(owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))
    example, further = (F.col("owners") > most_owners) | (F.col("repos") > most_repos), F.col("kind") == 3
    judged = each.join(owned, "value").groupBy("row").agg(
        F.count_if(further & example).alias("n_example"),
        F.array_sort(F.collect_list(F.when(further & ~example, F.struct("start", "end")))).alias("live"),
        F.count_if(~further & ~example).alias("n_base_live"),
        F.array_sort(F.collect_list(F.when(~further & example, F.struct("start", "kind", "end")))).alias("copied"),
    )
    # both lists are in order; a live place goes among the base ones by its start
    base = F.filter(F.split("base", ","), lambda s: s != "")
    placed = F.transform(base, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.when(s.startswith("assign"), 0).when(s.startswith("access"), 1).otherwise(2).alias("k"), s.alias("s")))
    lived = F.transform(F.col("live"), lambda x: F.struct(x["start"].alias("a"), F.lit(3).alias("k"), F.concat_ws(":", F.lit("live"), x["start"].cast("string"), x["end"].cast("string")).alias("s")))
    spans = F.when(F.size("live") > 0, F.array_join(F.transform(F.array_sort(F.concat(placed, lived)), lambda x: x["s"]), ",")).otherwise(F.col("base"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.col("copied"), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return found.join(judged, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.when(F.size("live") > 0, F.size("live")).otherwise(0).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        "base_sha256",
        F.coalesce(spans, F.col("base")).alias("spans"),
        F.coalesce("n_base_live", F.lit(0)).cast("long").alias("n_base_live"),
        F.when(F.size("copied") > 0, F.size("copied")).otherwise(0).cast("long").alias("n_base_example"),
        F.coalesce(F.array_join(named, ","), F.lit("")).alias("base_examples"),
    )
