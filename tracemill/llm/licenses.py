"""License scans by ordered signature rules.

Keywords gate the rules: one pass of an Aho-Corasick automaton over a text finds which can match at all, and only their
regular expressions run. Overlapping detections are resolved by priority: rules rank by kind and order, and a detection
goes if it lies inside a kept one, or overlaps one of a stronger kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import documents, slices
from tracemill.llm.license_rules import KINDS, NAMES, TAGS, TEXTS


@dataclass(frozen=True)
class Rule:
    number: int
    name: str
    license: str
    priority: int
    keywords: tuple[tuple[str, ...], ...]  # of each group, one must occur
    pattern: re.Pattern
    operand: re.Pattern | None = None  # of a tag: the identifier after an operator of an SPDX expression


#: What an SPDX expression stands behind, and the expression, a term at least. No term is read in two ways, so none is tried twice.
HEADER = r"\bspdx-license-identifier:\s*|\blicen[cs]e\s*[:=]\s*[\"']?"
TERM = r"(?:\(\s*)*+[\w.+:-]++(?:\s*\))*+"
EXPRESSION = re.compile(rf"(?:{HEADER}){TERM}(?:\s+(?:and|or|with)\s+{TERM})++", re.IGNORECASE)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, the preferred first within each kind."""
    found: list[tuple[str, str, tuple[tuple[str, ...], ...], str]] = []
    for tag in TAGS.split():
        key = re.escape(tag)
        found.append(("tag", tag, ((tag.lower(),), ("licen",)), rf"(?:{HEADER})(?:\(\s*)*{key}(?![\w.+-])"))
    for line in TEXTS.strip().splitlines():
        license_, keywords, pattern = (x.strip() for x in line.split(" | "))
        found.append(("text", license_, (_any(keywords),), pattern))
    for line in NAMES.strip().splitlines():
        license_, keywords, name, url = (x.strip() for x in re.split(r"\s\|(?=\s|$)", line + " ", maxsplit=3))
        if url:
            found.append(("url", license_, (_hosts(url),), url))
        if name:
            found.append(("name", license_, (_any(keywords),), name))
    order = list(KINDS)
    found.sort(key=lambda x: order.index(x[0]))
    operand = lambda tag: re.compile(rf"\s(?:and|or|with)\s+(?:\(\s*)*({re.escape(tag)})(?![\w.+-])", re.IGNORECASE)
    return tuple(Rule(i, f"{kind}:{license_}:{i}", license_, KINDS[kind], keywords, re.compile(pattern, re.IGNORECASE), operand(license_) if kind == "tag" else None) for i, (kind, license_, keywords, pattern) in enumerate(found))


def _any(keywords: str) -> tuple[str, ...]:
    return tuple(k.strip() for k in keywords.split(";"))


def _hosts(url: str) -> tuple[str, ...]:
    """The first label of the host that each alternative of a url's pattern begins with."""
    alternatives = url[3:-1].split("|") if url.startswith("(?:") and url.endswith(")") else [url]
    return tuple(re.match(r"[\w-]+", x)[0] for x in alternatives)


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    by: dict[str, list[tuple[int, int]]] = {}
    for r in rules():
        for group, keywords in enumerate(r.keywords):
            for k in keywords:
                by.setdefault(k, []).append((r.number, group))
    for k, groups in by.items():
        a.add_word(k, tuple(groups))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """In lower case, with the letters that ``re.IGNORECASE`` takes for i and s, and any white space as one space."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return " ".join(text.lower().split())


def candidates(text: str) -> list[int]:
    """Numbers of the rules of whose keywords one of each group occurs."""
    met = {groups for _, groups in automaton().iter(folded(text))}
    count = Counter(n for n, _ in set().union(*met))
    every = rules()
    return sorted(n for n, c in count.items() if c == len(every[n].keywords))


def matches(text: str, numbers: list[int]) -> list[tuple[int, int, int]]:
    """(rule, start, end) of all matches of these rules that aren't empty. Of an SPDX expression, the first identifier is
    matched with what it stands behind, each of the others by itself."""
    every = rules()
    found = [(n, m.start(), m.end()) for n in numbers for m in every[n].pattern.finditer(text) if m.end() > m.start()]
    if tags := [n for n in numbers if every[n].operand]:
        for e in EXPRESSION.finditer(text):
            found += [(n, *m.span(1)) for n in tags for m in every[n].operand.finditer(text, e.start(), e.end())]
    return found


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections that stay, by place. In order of kind, length, place and rule, each stays unless it lies inside one that
    stayed or overlaps one that stayed of a stronger kind.

    Of one kind, no detection that stays lies inside another, so that the last to begin before a place ends last; what
    stronger kinds cover is kept as intervals apart from each other. Both are found by bisection."""
    every = rules()
    kept: list[tuple[int, int, int]] = []
    begins: list[int] = []  # of what stronger kinds cover
    ends: list[int] = []
    for _, kind in groupby(sorted(found, key=lambda d: (-every[d[0]].priority, d[1] - d[2], d[1], d[0])), key=lambda d: every[d[0]].priority):
        here: list[tuple[int, int, int]] = []  # (begin, end, rule)
        for n, a, b in kind:
            over = bisect_left(begins, b) - 1
            if over >= 0 and ends[over] > a:
                continue
            at = bisect_right(here, (a, float("inf"), 0))
            if at and here[at - 1][1] >= b:
                continue
            here.insert(at, (a, b, n))
        kept += [(n, a, b) for a, b, n in here]
        covered: list[list[int]] = []
        for a, b in sorted([*zip(begins, ends), *((a, b) for a, b, _ in here)]):
            if covered and a < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        begins, ends = [a for a, _ in covered], [b for _, b in covered]
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, license, rule, priority, start, end, matched)``: a row for each detection in ``docs(doc_id, text)``.

    ``start`` and ``end`` count characters. Null and empty texts, and texts without a detection, give no rows; repeated
    rows give theirs each; an empty table gives none. Texts are scanned whole, however long. Other columns are ignored,
    whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rules()
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in range(7)]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text and (numbers := candidates(text)):
                        for n, a, b in resolve(matches(text, numbers)):
                            for o, v in zip(out, (doc, every[n].license, every[n].name, every[n].priority, a, b, text[a:b])):
                                o.append(v)
                if out[0]:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["doc_id", "license", "rule", "priority", "start", "end", "matched"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, license string, rule string, priority int, start int, end int, matched string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
