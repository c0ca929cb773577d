"""Multiple-alignment (MAF) blocks: reading, and conversion to AXT-like, tabular, PSL, SAM, BLAST-like and HTML lines.

A block is one paragraph of a file; blocks are read as rows and converted each on its own."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Row:
    """One `s` line. `per` is the sequence letters that an aligned letter stands for: 3 for translated ones."""

    name: str
    start: int
    size: int
    strand: str
    length: int
    text: str

    def advance(self, text: str) -> int:
        """Sequence letters under a piece of the aligned text; frameshifts move by one."""
        ahead, back = text.count("\\"), text.count("/")
        return (len(text) - text.count("-") - ahead - back) * self.per + ahead - back

    @property
    def per(self) -> int:
        shifts = self.text.count("\\") + self.text.count("/")
        return 3 if shifts or len(self.text) - self.text.count("-") - shifts < self.size else 1

    @property
    def forward_span(self) -> tuple[int, int]:
        end = self.start + self.size
        return (self.start, end) if self.strand == "+" else (self.length - end, self.length - self.start)


@dataclass
class Block:
    values: dict[str, str]
    rows: list[Row]
    qualities: list[tuple[str, str]] = field(default_factory=list)
    probabilities: list[str] = field(default_factory=list)

    def columns(self, upper: bool = False) -> list[tuple[str, ...]]:
        return list(zip(*(r.text.upper() if upper else r.text for r in self.rows)))

    def pair(self) -> tuple[Row, Row]:
        if len(self.rows) != 2:
            raise ValueError("only pairwise alignments can be converted to this format")
        return self.rows[0], self.rows[1]


def parse_block(paragraph: str) -> Block | None:
    """The block of a paragraph, or None if it has none (comments)."""
    values, rows, qualities, probabilities = None, [], [], []
    for line in paragraph.splitlines():
        kind, *words = line.split() or [""]
        if kind == "a":
            values = dict(w.split("=", 1) for w in words if "=" in w)
        elif kind == "s":
            rows.append(Row(words[0], int(words[1]), int(words[2]), words[3], int(words[4]), words[5]))
        elif kind == "q":
            qualities.append((words[0], words[1]))
        elif kind == "p":
            probabilities.append(words[0])
    return None if values is None else Block(values, rows, qualities, probabilities)


def gap_runs(block: Block) -> Iterator[tuple[int, list[int]]]:
    """Runs of columns: (columns, []) without gaps, (0, letters of each row) with them."""
    at = 0
    for gapless, run in groupby(block.columns(), lambda c: "-" not in c):
        n = len(list(run))
        yield (n, []) if gapless else (0, [r.advance(r.text[at : at + n]) for r in block.rows])
        at += n


def to_axt(block: Block) -> list[str]:
    """Names and spans from 1, in a line."""
    if block.rows[0].strand != "+":
        raise ValueError("the first strand must be + here")
    return [" ".join(f"{r.name} {r.start + 1} {r.start + r.size}" for r in block.rows)]


def to_tab(block: Block) -> list[str]:
    words = [str(x) for r in block.rows for x in (r.name, r.start, r.size, r.strand, r.length)]
    words.append(",".join(str(n) if not inserts else ":".join(map(str, inserts)) for n, inserts in gap_runs(block)))
    return ["\t".join(words + [block.values[k] for k in ("expect", "mismap") if k in block.values])]


def to_psl(block: Block, protein: bool = False) -> list[str]:
    target, query = block.pair()
    strand = query.strand + (target.strand if max(target.per, query.per) > 1 else "")
    if max(target.per, query.per) == 1 and target.strand != "+":
        raise ValueError("the first strand must be + here")
    same = other = unknown = 0
    for x, y in block.columns(upper=True):
        if "-" in (x, y):
            continue
        if protein or x in "ACGTU" and y in "ACGTU":
            same, other = same + (x == y), other + (x != y)
        else:
            unknown += 1
    filled = same + other + unknown
    places, sizes, starts = [r.start for r in block.rows], [], []
    for n, inserts in gap_runs(block):
        if not inserts:
            sizes.append(n)
            starts.append(tuple(places))
        places = [p + (n * r.per if not inserts else i) for p, r, i in zip(places, block.rows, inserts or [0, 0], strict=True)]
    listed = lambda xs: "".join(f"{x}," for x in xs)
    gaps = [len(re.findall("-+", r.text)) for r in block.rows]
    (t0, t1), (q0, q1) = target.forward_span, query.forward_span
    words = (same, other, 0, unknown, gaps[0], query.size - filled * query.per, gaps[1], target.size - filled * target.per, strand, query.name, query.length, q0, q1, target.name, target.length, t0, t1, len(sizes), listed(sizes), listed(s[1] for s in starts), listed(s[0] for s in starts))
    return ["\t".join(map(str, words))]


def mapq(probability: str) -> str:
    """Mapping quality of an error probability: at most 254."""
    p = float(probability)
    if not 0 <= p <= 1:
        raise ValueError(f"bad probability: {probability}")
    return str(254 if p == 0 or -10 * math.log10(p) >= 254 else round(-10 * math.log10(p)))


def cigar(target: str, query: str, before: int = 0, after: int = 0) -> str:
    """Run lengths of columns, with hard clips for what lies outside."""

    def kind(pair: tuple[str, str]) -> str:
        x, y = pair
        return ("P" if y == "-" else "I") if x == "-" else "D" if y == "-" else "=" if x == y else "X"

    body = "".join(f"{len(list(run))}{k}" for k, run in groupby(zip(target.upper(), query.upper(), strict=True), kind))
    return (f"{before}H" if before else "") + body + (f"{after}H" if after else "")


def sam_header(lengths: dict[str, int], read_group: str | None = None) -> list[str]:
    lines = ["@HD\tVN:1.3\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{lengths[n]}" for n in sorted(lengths, key=karyotypic_key))]
    return lines + ([f"@RG\t{read_group}"] if read_group else [])


def natural_key(name: str) -> list:
    """Sorts runs of digits by their number; text and numbers never meet in one place."""
    return [(1, int(x), "") if x.isdigit() else (2, 0, x) for x in re.findall(r"\d+|\D+", name)]


def karyotypic_key(name: str) -> list:
    """Natural order, the mitochondrial chrM first and MT last."""
    return [] if name == "chrM" else [(3, 0, "")] if name == "MT" else natural_key(name)


#: SAM flags by mate (0: none) and strand.
FLAGS = {(0, "+"): 0, (0, "-"): 16, (1, "+"): 99, (1, "-"): 83, (2, "+"): 163, (2, "-"): 147}


def to_sam(block: Block, read_group: str | None = None) -> list[str]:
    target, *queries = block.rows
    if any(r.per == 3 for r in block.rows):
        raise ValueError("translated alignments can't be converted to SAM")
    if target.strand != "+":
        raise ValueError("the first strand must be + here")
    quality = mapq(block.values["mismap"]) if "mismap" in block.values else "255"
    out = []
    for q in queries:
        name, mate = (q.name[:-2], int(q.name[-1])) if q.name.endswith(("/1", "/2")) else (q.name, 0)
        letters = "*"
        if block.qualities:
            if len(block.qualities) > 1 or len(queries) > 1 or block.qualities[0][0] != q.name:
                raise ValueError("the qualities belong to no query")
            letters = "".join(b for a, b in zip(q.text, block.qualities[0][1], strict=False) if a != "-")
        edits = sum(x != y for x, y in zip(target.text.upper(), q.text.upper(), strict=True))
        words = [name, FLAGS[mate, q.strand], target.name, target.start + 1, quality, cigar(target.text, q.text, q.start, q.length - q.start - q.size), "*\t0\t0", q.text.replace("-", ""), letters, f"NM:i:{edits}"]
        if re.fullmatch(r"\s*[+-]?\d+\s*", block.values.get("score", "")):
            words.append(f"AS:i:{int(block.values['score'])}")
        if "expect" in block.values:
            words.append(f"EV:Z:{block.values['expect']}")
        out.append("\t".join(map(str, [*words, *([read_group] if read_group else [])])))
    return out


def coordinate(one_based: int, strand: str, length: int) -> int:
    return one_based if strand == "+" else length - one_based + 1


def _wrapped(block: Block, width: int) -> Iterator[tuple[int, list[str], list[str], list[str]]]:
    """Pieces of the rows with the coordinates they begin and end at."""
    places = [r.start for r in block.rows]
    for at in range(0, len(block.rows[0].text), width):
        texts = [r.text[at : at + width] for r in block.rows]
        begins = [str(coordinate(p + 1, r.strand, r.length)) for p, r in zip(places, block.rows, strict=True)]
        places = [p + r.advance(t) for p, r, t in zip(places, block.rows, texts, strict=True)]
        yield at, texts, begins, [str(coordinate(p, r.strand, r.length)) for p, r in zip(places, block.rows, strict=True)]


def _symbols(texts: list[str], mark: str) -> str:
    return "".join(mark if len(set(c)) == 1 else " " for c in zip(*(t.upper() for t in texts)))


def to_blast(block: Block, width: int = 60) -> list[str]:
    target, query = block.pair()
    columns = block.columns(upper=True)
    matches, gaps = sum(x == y for x, y in columns), sum("-" in c for c in columns)
    share = lambda n: f"{n}/{len(columns)} ({100 * n // len(columns)}%)"
    sides = {"+": "Plus", "-": "Minus"}
    out = [f"Query= {query.name}", f"         ({query.length} letters)", "", f">{target.name}", f"          Length = {target.length}", ""]
    out.append(f" Score = {block.values['score']}" + (f", Expect = {block.values['expect']}" if "expect" in block.values else ""))
    out.append(f" Identities = {share(matches)}" + (f", Gaps = {share(gaps)}" if gaps else ""))
    out += [f" Strand = {sides[query.strand]} / {sides[target.strand]}", ""]
    for _, texts, begins, ends in _wrapped(block, width):
        wide = max(map(len, begins))
        out += [f"Query: {begins[1]:<{wide}} {texts[1]} {ends[1]}", f"       {'':<{wide}} {_symbols(texts, '|')}", f"Sbjct: {begins[0]:<{wide}} {texts[0]} {ends[0]}", ""]
    return out


#: Classes of columns by the least quality of their error probability.
PROBABILITY_CLASSES = ((30, "a"), (20, "b"), (13, "c"), (10, "d"), (3, "e"), (-math.inf, "f"))


def probability_class(column: tuple[str, ...]) -> str:
    quality = ord(min(column)) - 33
    return next(name for least, name in PROBABILITY_CLASSES if quality >= least)


def to_html(block: Block, width: int = 60) -> list[str]:
    title = "Alignment" + (f" score={block.values['score']}" if "score" in block.values else "") + (f", expect={block.values['expect']}" if {"score", "expect"} <= set(block.values) else "")
    classes = [probability_class(c) for c in zip(*block.probabilities)] if block.probabilities else None
    names = max(len(r.name) for r in block.rows)
    out = [f"<h3>{title}:</h3>", "<pre>"]
    for at, texts, begins, ends in _wrapped(block, width):
        left, right = max(map(len, begins)), max(map(len, ends))
        for r, text, begin, end in zip(block.rows, texts, begins, ends, strict=True):
            shown = text
            if classes:
                runs = groupby(zip(classes[at : at + width], text, strict=False), lambda x: x[0])
                shown = "".join(f'<span class="{k}">{"".join(c for _, c in run)}</span>' for k, run in runs)
            out.append(f"{r.name:<{names}} {begin:>{left}} {shown} {end:>{right}}")
        out += [f"{'':{names}} {'':{left}} {_symbols(texts, '*')}", ""]
    return [*out, "</pre>"]


WRITERS = {"axt": to_axt, "tab": to_tab, "psl": to_psl, "sam": to_sam, "blast": to_blast, "html": to_html}


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of MAF files as rows."""
    return spark.read.text(path, lineSep="\n\n").where(F.col("value").rlike(r"(?m)^a(\s|$)"))


def converted(paragraphs: DataFrame, kind: str) -> DataFrame:
    """`value` lines of every paragraph in a format, with the paragraph's number in its partition as order."""
    write = WRITERS[kind]

    def run(batches):
        n = 0
        for batch in batches:
            numbers, lines = [], []
            for paragraph in batch.column("value").to_pylist():
                block = parse_block(paragraph or "")
                for line in write(block) if block else []:
                    numbers.append(n)
                    lines.append(line)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["block", "value"])

    return paragraphs.select("value").mapInArrow(run, "block long, value string")
