"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from byte-trigram counts of all
labelled documents, gathered by grouped aggregation. Pages add three pieces of
evidence: the language their markup declares, weighed by how often a declaration
agrees with what the texts say; the suffix of the address; and a prior of the
host, smoothed towards its domain's, which is smoothed towards the whole table's.
These tables, too, are grouped aggregates over all rows, with a row's own vote
taken out of its host's and domain's counts.

Trigrams overlap, so a text counts as ``EFFECTIVE`` independent ones at most.

Edge cases: null and empty texts have no text evidence and follow the rest; a
null or malformed url has no host or suffix; unknown or malformed declarations
count as none; rows with a null language don't train; with no language known the
answer is null; repeated rows count each; clashing extra columns aren't read;
empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

SLOTS = 1 << 15
EFFECTIVE = 60.0
#: Languages are a closed list; more than this many distinct names are refused.
MAX_LANGUAGES = 256
PSEUDO = 20.0

_OPENING = re.compile(r"<(?:(!--)|(script|style)\b)?", re.IGNORECASE)
_CLOSING = {"!--": re.compile("-->"), **{k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style")}}
_ENTITY = re.compile(r"&[#A-Za-z0-9]{1,10};")
# Attributes of the first <html> tag, and the language among them.
_ROOT = r"(?is)^.*?<html\b([^<>]*+)"
_DECLARED = r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])"


def visible(html: str) -> str:
    """Text of a page without markup, scripts, styles and comments, in one pass.

    A script, style or comment without its end is a tag; a sign < that no > follows is text.
    """
    out, at, endless = [], 0, set()
    while m := _OPENING.search(html, at):
        kind, end = (m[1] or m[2] or "").lower(), 0
        # An end that isn't found once isn't found later either, so it's not looked for again.
        if kind and kind not in endless:
            if closing := _CLOSING[kind].search(html, m.end()):
                end = closing.end()
            else:
                endless.add(kind)
        end = end or html.find(">", m.start()) + 1
        if not end:
            break
        out.append(html[at : m.start()])
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", " ".join(out))


def trigram_slots(text: bytes) -> np.ndarray:
    raw = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 15)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray
    """Log-probability of every slot: a row for each slot, a column for each language."""


def _counted(batches):
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for i, lang in enumerate(batch.column(0).to_pylist()):
            own = found.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
            if len(found) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            text = batch.column(1)[i].as_buffer().to_pybytes()
            for at in range(0, len(text), 1 << 18):
                own += np.bincount(trigram_slots(text[at : at + (1 << 18)]), minlength=SLOTS)
    lang, slot, n = [], [], []
    for name, counts in found.items():
        held = np.flatnonzero(counts)
        lang += [name] * len(held)
        slot.append(held)
        n.append(counts[held])
    flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(flat(slot).astype(np.int32)), pa.array(flat(n))], ["lang", "slot", "n"])


def train(docs: DataFrame) -> Model:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    counts = (
        docs.where(F.col("lang").isNotNull())
        .select("lang", text)
        .mapInArrow(_counted, "lang string, slot int, n bigint")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counts.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {n: i for i, n in enumerate(languages)}
    table = np.full((SLOTS, len(languages)), 0.5)
    if languages:
        np.add.at(table, (counts.column("slot").to_numpy(), [place[n] for n in names]), counts.column("n").to_numpy())
    return Model(languages, (np.log(table) - np.log(table.sum(axis=0, keepdims=True))).astype(np.float32))


def _likelihoods(batches, logs, html: bool):
    """Adds the text's tempered log-likelihoods, the best at zero, and the best language's position."""
    for batch in batches:
        out, vote = [], []
        texts = batch.column("text")
        for i in range(batch.num_rows):  # one at a time: a batch of whole pages is large enough once
            text = texts[i].as_py()
            text = visible(text) if html and text else text or ""
            total, n = np.zeros(logs.value.shape[1]), 0
            raw = text.encode("utf-8", "replace")
            if text.strip():
                for at in range(0, len(raw), 1 << 18):
                    slots = trigram_slots(raw[at : at + (1 << 18)])
                    total += logs.value[slots].sum(axis=0, dtype=np.float64)
                    n += len(slots)
            total = total * min(1.0, EFFECTIVE / n) if n else total
            total = np.round(total - total.max(), 9) if len(total) else total
            out.append(total)
            vote.append(int(total.argmax()) if n and len(total) else None)
        keep = [batch.column(c) for c in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(out, pa.list_(pa.float64())), pa.array(vote, pa.int32())], [*names, "text_logs", "vote"]
        )


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, registrable part (last two labels) and suffix (last label); null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host.contains("."), host)
    return host, F.substring_index(host, ".", -2), F.when(F.rlike(F.substring_index(host, ".", -1), F.lit("^[a-z]{2,24}$")), F.substring_index(host, ".", -1))


def _votes(size: int) -> Column:
    """Rows that vote for each language, as an array."""
    return F.array(*[F.count(F.when(F.col("vote") == k, 1)).cast("double") for k in range(size)])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def identify(rows: DataFrame, model: Model, html: bool, carried: list[str]) -> DataFrame:
    """``carried`` columns, lang, confidence, text_lang and declared of every row.

    ``rows`` has the carried columns, host, domain, suffix and declared (nulls
    allowed) and text.
    """
    size = len(model.languages)
    if not size:
        unknown = F.lit(None).cast("string")
        return rows.select(*carried, unknown.alias("lang"), F.lit(None).cast("double").alias("confidence"), unknown.alias("text_lang"), "declared")
    logs = rows.sparkSession.sparkContext.broadcast(model.logs)
    evidence = ["host", "domain", "suffix", "declared"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*carried, *evidence]), "text_logs array<double>", "vote int"])
    scored = materialize(rows.select(*carried, *evidence, "text").mapInArrow(lambda b: _likelihoods(b, logs, html), schema), "scored")
    none = F.array(*[F.lit(0.0)] * size)
    votes = lambda by: scored.where(f"{by} is not null").groupBy(by).agg(_votes(size).alias(f"{by}_votes"))
    overall = [float(x) for x in scored.agg(_votes(size).alias("v")).first()["v"]]
    whole = sum(overall)
    base = F.array(*[F.lit((x + 1.0) / (whole + size)) for x in overall])
    joined = scored
    for by in ("domain", "host", "suffix", "declared"):
        # Hot hosts are a skewed join of narrow rows, which adaptive execution splits.
        joined = joined.join(votes(by), by, "left")
    mine = F.transform(none, lambda _, i: (F.coalesce(F.col("vote"), F.lit(-1)) == i).cast("double"))
    without = lambda by: F.zip_with(F.coalesce(f"{by}_votes", mine), mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    smoothed = lambda counts, to: F.zip_with(
        counts, to, lambda c, p: (c + F.lit(PSEUDO) * p) / (_total(counts) + F.lit(PSEUDO))
    )
    # P(evidence | language) = share of the language's rows that show it, against its share of all rows.
    spoken = F.array(*[F.lit(x + float(size)) for x in overall])
    shown = lambda by: F.when(
        F.col(by).isNull(), none
    ).otherwise(F.zip_with(F.coalesce(f"{by}_votes", none), spoken, lambda c, n: F.log((c + 0.5) / n)))
    prior = smoothed(F.col("without_host"), smoothed(F.col("without_domain"), base))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = joined.withColumn("without_host", without("host")).withColumn("without_domain", without("domain"))
    fused = fused.withColumn("prior", F.transform(prior, lambda p: F.log(p)))
    fused = fused.withColumn("total", add(add(F.col("text_logs"), F.col("prior")), add(shown("declared"), shown("suffix"))))
    fused = fused.withColumn("best", F.array_max("total"))
    names = F.array(*[F.lit(x) for x in model.languages])
    at = F.array_position("total", F.col("best")).cast("int") - 1
    return fused.select(
        *carried,
        F.get(names, at).alias("lang"),
        (F.lit(1.0) / _total(F.transform("total", lambda x: F.exp(x - F.col("best"))))).alias("confidence"),
        F.get(names, F.col("vote")).alias("text_lang"),
        "declared",
    )


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared."""
    host, domain, suffix = address(F.col("url"))
    root = F.regexp_extract(F.coalesce("html", F.lit("")), _ROOT, 1)
    declared = F.lower(F.regexp_extract(root, _DECLARED, 1))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        host.alias("host"),
        domain.alias("domain"),
        suffix.alias("suffix"),
        F.when(declared != "", declared).alias("declared"),
        F.col("html").alias("text"),
    )
    return identify(rows, model, True, ["page_id"])


def of_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, confidence, text_lang; a document's source stands for its host."""
    nothing = F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").alias("host"),
        nothing.alias("domain"),
        nothing.alias("suffix"),
        nothing.alias("declared"),
        "text",
    )
    return identify(rows, model, False, ["doc_id"]).drop("declared")
