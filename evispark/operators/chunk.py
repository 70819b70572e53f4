"""Chunkers: table functions from one text to its chunks, run batch-wise in Arrow."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", " ")
HEADER = re.compile(r"^\s*(?:\d+\.?\s*)?(abstract|introduction|background|methods?|results?|discussion|conclusions?|references)\s*:?\s*$", re.I | re.M)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LABEL = re.compile(r"\b(BACKGROUND|OBJECTIVES?|PURPOSE|METHODS?|RESULTS?|CONCLUSIONS?)\s*:\s*")


def recursive_chunks(text: str | None, most: int = 512, overlap: int = 50) -> list[str]:
    """Pieces of at most ``most`` characters cut at the coarsest separator that serves, each but the first behind the end of the one before."""

    def split(part: str, level: int) -> list[str]:
        if len(part) <= most:
            return [part]
        if level == len(SEPARATORS):
            return [part[i : i + most] for i in range(0, len(part), most)]
        out, now = [], ""
        for bit in part.split(SEPARATORS[level]):
            joined = now + SEPARATORS[level] + bit if now else bit
            if len(joined) <= most:
                now = joined
                continue
            if now:
                out.append(now)
            now = bit
            if len(bit) > most:
                *done, now = split(bit, level + 1)
                out += done
        return [*out, now] if now else out

    found = [c for c in (p.strip() for p in split((text or "").strip(), 0)) if c]
    out = found[:1]
    for before, chunk in zip(found, found[1:]):
        tail = before[-overlap:] if overlap else ""
        tail = tail[tail.find(" ") + 1 :] if " " in tail else tail
        out.append(f"{tail} {chunk}" if tail else chunk)
    return out


def section_chunks(text: str | None, most_words: int = 500) -> list[tuple[str, str]]:
    """(section, chunk): sections by header lines, without references, packed by sentences up to a number of words."""
    text = text or ""
    heads = list(HEADER.finditer(text))
    bodies = [(h[1].lower(), text[h.end() : n.start() if n else len(text)]) for h, n in zip(heads, [*heads[1:], None])] if heads else [("body", text)]
    out: list[tuple[str, str]] = []
    for name, body in bodies:
        if name == "references":
            continue
        now: list[str] = []
        count = 0
        for sentence in SENTENCE.split(body.strip()):
            n = len(sentence.split())
            if now and count + n > most_words:
                out.append((name, " ".join(now)))
                now, count = [], 0
            if n:
                now.append(sentence.strip())
                count += n
        if now:
            out.append((name, " ".join(now)))
    return out


def merged(chunks: list[str], least: int = 200, most: int = 1500) -> list[str]:
    """Chunks shorter than ``least`` joined to the one before as long as both fit into ``most`` characters."""
    out: list[str] = []
    for chunk in chunks:
        if out and min(len(chunk), len(out[-1])) < least and len(out[-1]) + 1 + len(chunk) <= most:
            out[-1] = f"{out[-1]} {chunk}"
        else:
            out.append(chunk)
    return out


def paragraph_chunks(text: str | None, least: int = 200, most: int = 1500) -> list[str]:
    """Paragraphs, short ones joined and long ones cut: what stands in where no model marks the topics of a text."""
    paragraphs = [p for part in re.split(r"\n\s*\n", text or "") for p in recursive_chunks(part, most, 0)]
    return merged(paragraphs, least, most)


TIER_ONE = {"abstract", "results", "result", "conclusion", "conclusions"}


def tiered_chunks(text: str | None, most: int = 512, overlap: int = 50) -> list[tuple[str, str]]:
    """(section, chunk) where sections that matter most are marked "1:" before their name, all others "2:"; each section is cut by ``recursive_chunks``."""
    text = text or ""
    heads = list(HEADER.finditer(text))
    bodies = [("other", text[: heads[0].start()] if heads else text)]
    bodies += [(h[1].lower(), text[h.end() : n.start() if n else len(text)]) for h, n in zip(heads, [*heads[1:], None])]
    return [(f"{1 if name in TIER_ONE else 2}:{name}", chunk) for name, body in bodies if body.strip() for chunk in recursive_chunks(body, most, overlap)]


def structured_abstract(text: str | None, most: int = 1500) -> list[tuple[str, str]]:
    """(label, chunk) of an abstract with two labels or more; none else."""
    text = text or ""
    marks = list(LABEL.finditer(text))
    if len(marks) < 2:
        return []
    parts = [(m[1].lower(), text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(marks, [*marks[1:], None])]
    return [(label, chunk) for label, body in parts for chunk in (recursive_chunks(body, most, 0) or [])]


def explode_text(docs: DataFrame, fn: Callable[[str | None], list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, section, content) of every chunk that ``fn`` cuts; plain strings have section ``body``."""
    id_field = docs.schema[id_col]
    schema = T.StructType([id_field, T.StructField("chunk_index", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("content", T.StringType())])

    def run(batches):
        for batch in batches:
            ids, index, section, content = [], [], [], []
            for i, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()):
                for k, chunk in enumerate(fn(text)):
                    name, body = chunk if isinstance(chunk, tuple) else ("body", chunk)
                    ids.append(i)
                    index.append(k)
                    section.append(name)
                    content.append(body)
                    if len(ids) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(id_col).type), pa.array(index, pa.int32()), pa.array(section, pa.string()), pa.array(content, pa.string())], names=schema.names)
                        ids, index, section, content = [], [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(id_col).type), pa.array(index, pa.int32()), pa.array(section, pa.string()), pa.array(content, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
