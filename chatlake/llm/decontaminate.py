"""Benchmark decontamination by one Aho-Corasick automaton.

All windows of the normalised benchmark items are the keys of one automaton. A
task reads each document's text once through it; hits come back as word numbers
and as spans of the original text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import aside, back, cols, fresh, without
from chatlake.session import ship_package

WINDOW = 10
#: Normalised benchmark bytes that one automaton may hold: about 8 windows' bytes
#: each, some 300 MB in a task. A larger benchmark is scanned in several parts,
#: one automaton after the other.
PART_BYTES = 1 << 20

#: Byte by byte: A-Z to lower case, 0-9, a-z and all of non-ASCII stay, the rest
#: of ASCII separates words.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<struct<start:long,end:long>>")


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def automaton(items: list[tuple[str, bytes]], window: int = WINDOW):
    """Keys: ' w1 w2 .. wn ' for each window; values: (words, items). Bytes are
    taken as Latin-1 characters, one for one."""
    import ahocorasick

    keys: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = normalise(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = f" {b' '.join(words[i:i + n]).decode('latin-1')} "
            keys.setdefault(key, (n, set()))[1].add(item)
    out = ahocorasick.Automaton()
    for k, v in keys.items():
        out.add_word(k, v)
    out.make_automaton()
    return out if keys else None


def scan(found, flat: str, hits: set[int], items: set[str]) -> None:
    """Add to ``hits`` the word numbers of ``flat`` (' w1 w2 .. wn ') inside a
    window's occurrence, and the windows' items to ``items``."""
    word = at = 0                       # words before position ``at``
    done: dict[int, int] = {}           # by a window's length: words behind its last hit
    for end, (n, of) in found.iter(flat):
        word += flat.count(" ", at, end)
        at = end                        # flat[end] is the blank behind the window
        hits.update(range(max(done.get(n, 0), word - n), word))
        done[n] = word
        items |= of


def spans_of(text: str, hits: list[int]) -> list[dict]:
    """Original character spans of the runs of hit words."""
    words = [m.span() for m in _WORDS.finditer(text)]
    out: list[dict] = []
    for k, w in enumerate(hits):
        if k and hits[k - 1] == w - 1:
            out[-1]["end"] = words[w][1]
        else:
            out.append({"start": words[w][0], "end": words[w][1]})
    return out


def _scanner(parts, window: int):
    def run(batches):
        import pyarrow as pa

        built: dict[int, object] = {}

        def part(i):
            if i not in built:
                built.clear()           # one automaton at a time
                built[i] = automaton(parts[i].value, window)
            return built[i]

        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            flats = [b" ".join(normalise(t or b"")) for t in texts]
            got = [(set(), set()) for _ in texts]
            for i in range(len(parts)):
                if (found := part(i)) is not None:
                    for flat, (hits, items) in zip(flats, got):
                        scan(found, f" {flat.decode('latin-1')} ", hits, items)
            rows = []
            for t, flat, (hits, items) in zip(texts, flats, got):
                names = ",".join(sorted(items)).encode()
                rows.append((flat.count(b" ") + 1 if flat else 0, len(hits), len(items), hashlib.sha256(names).hexdigest(),
                             bool(hits), spans_of(t.decode(), sorted(hits)) if hits else []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            new = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *new],
                [*b.schema.names[:-1], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])
    return run


def scan_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans
    (start and end characters of the hit runs in the original text). Columns of
    these names in the input are replaced.

    NULL and wordless texts have no words and no hits; items without words have
    no windows; items of equal id are one; a NULL item id is the text 'null'. An
    empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("i"),
                         F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).cast("binary").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    parts = [spark.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in items.where(part == k).collect()])
             for k in range(n)]
    docs = without(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    rows = docs.select(*cols(docs), F.col(f"`{text_col}`").cast("binary").alias(*fresh(docs, "scan")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(_scanner(parts, window), f"{kinds}, {SCHEMA}")


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those that hold a benchmark window; columns unchanged."""
    rows, names = aside(docs)
    return back(scan_documents(rows, bench, text_col=names[text_col], **how).where("NOT contaminated"), names)
