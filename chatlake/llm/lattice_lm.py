"""Language-model scores from a subword lattice.

The pieces of an existing subword vocabulary span a lattice over every word: an
arc for each piece wherever it matches, one for each byte, and one that stops the
word. The forward recursion over it, in log space, gives the marginal probability
of the word's spelling, all segmentations together. The weights start from the
vocabulary's own scores and are fitted to the training words by expectation
maximisation; the pieces stay as they are.

One more arc spans a word whole, with its discounted share of the training
tokens; what the discount leaves goes to the spelling. No arc crosses a word's
end, so a text's forward variable at a word boundary is a product, and a text's
log probability is the sum over its words and its end. Documents are dealt into
blocks; a block numbers its distinct words, keeps its texts as these numbers,
sends the words, and gets back their counts and log probabilities. So a word
crosses the network once a block, and goes through the recursion about once.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import written
from chatlake.session import ship_package

BLOCK_BYTES = 16 << 20      # text bytes of a block (one long text may be more)
FLAT_BYTES = 1 << 17        # word bytes that go through the recursion at once
LONG = 256                  # bytes of a word from which it is walked alone
ROUNDS = 2                  # of expectation maximisation
PRIOR = 2000.0              # pseudo-counts, shared out by the vocabulary's scores

#: Bytes to bytes: A-Z to lower case.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A word in the lattice is a blank, its bytes and a line feed; it holds neither.
_OPEN, _STOP = b" ", b"\n"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()       # bytes split at ASCII white space


def vocabulary(path: str, ranks: bool = True) -> dict[bytes, float]:
    """Piece to log weight, of a sentencepiece file: with ``ranks`` its scores are
    minus the rank of a piece, and the weight falls as one over the rank, else
    they are log probabilities. All 256 bytes are pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out, low = {}, 0.0
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        piece, score = sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i)
        if score < -1e8 or b" " in piece[1:]:
            continue
        out[piece] = -math.log1p(-score) if ranks else score
        low = min(low, out[piece])
    for b in range(256):
        out.setdefault(bytes([b]), low)
    return out


class Lattice:
    """Forward and backward recursions over the lattices of many words at once."""

    def __init__(self, pieces: list[bytes], weights):
        import ahocorasick
        import numpy as np

        self.weights = np.asarray(weights, dtype=np.float64)
        self.sizes = np.array([len(p) for p in pieces])
        self.arcs = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(pieces):
            self.arcs.add_word(p.decode("latin-1"), k)
        self.arcs.make_automaton()

    def _arcs(self, words: list[bytes]):
        """(word, from node, to node, piece) of all arcs, and the first node of
        each word. A word of n bytes has n + 3 nodes."""
        import numpy as np

        flat = b"".join([_OPEN + w + _STOP for w in words]).decode("latin-1")
        lengths = np.array([len(w) + 2 for w in words])
        got = np.fromiter(itertools.chain.from_iterable(self.arcs.iter(flat)), np.int64).reshape(-1, 2)
        end, piece = got[:, 0] + 1, got[:, 1]
        word = np.repeat(np.arange(len(words)), lengths)[end - 1]
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        return word, end - self.sizes[piece] + word, end + word, piece, first

    def _sweep(self, total, source, sink, weight, level):
        """State of every node: the log sum, over arcs into it, of the state they
        come from plus their weight; ``level`` orders the arcs."""
        import numpy as np

        state = np.zeros(total)
        order = np.lexsort((sink, level))
        source, sink, weight, level = source[order], sink[order], weight[order], level[order]
        head = np.flatnonzero(np.diff(sink, prepend=-1) | np.diff(level, prepend=-1))     # first arc of a node
        cuts = np.flatnonzero(np.diff(level[head], prepend=-1, append=-1))                # first node of a level
        ends = np.append(head, len(sink))
        for a, z in zip(cuts, cuts[1:]):
            i, j, own = ends[a], ends[z], head[a:z] - ends[a]
            v = state[source[i:j]] + weight[i:j]
            top = np.maximum.reduceat(v, own)
            sums = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(ends[a:z + 1]))), own)
            state[sink[head[a:z]]] = top + np.log(sums)
        return state

    def marginals(self, words: list[bytes]):
        """Log probability of each word's spelling, over all segmentations."""
        import numpy as np

        word, a, z, piece, first = self._arcs(words)
        state = self._sweep(first[-1], a, z, self.weights[piece], z - first[word])
        return state[first[1:] - 1]

    def long_marginal(self, word: bytes) -> float:
        """The same for one word of any length, with a window of states."""
        import numpy as np

        flat, width = (_OPEN + word + _STOP).decode("latin-1"), int(self.sizes.max()) + 1
        state, at, terms = np.full(width, -np.inf), 0, []
        state[0] = 0.0

        def settle():
            top = max(terms)
            state[at % width] = top + math.log(sum(math.exp(t - top) for t in terms))

        for end, piece in self.arcs.iter(flat):
            if end + 1 != at:
                if terms:
                    settle()
                at, terms = end + 1, []
            terms.append(state[(at - self.sizes[piece]) % width] + self.weights[piece])
        settle()
        return float(state[at % width])

    def expected(self, words: list[bytes]):
        """Expected uses of each piece, summed over the words."""
        import numpy as np

        word, a, z, piece, first = self._arcs(words)
        w = self.weights[piece]
        ahead = self._sweep(first[-1], a, z, w, z - first[word])
        behind = self._sweep(first[-1], z, a, w, first[word + 1] - a)
        whole = ahead[first[1:] - 1]
        return np.bincount(piece, np.exp(ahead[a] + w + behind[z] - whole[word]), len(self.weights))


def normalised(pieces: list[bytes], mass):
    """Log weights of ``mass``: what opens a word and the rest are a distribution each."""
    import numpy as np

    opens = np.array([p.startswith(_OPEN) for p in pieces])
    mass = np.asarray(mass, dtype=np.float64)
    return np.log(mass / np.where(opens, mass[opens].sum(), mass[~opens].sum()))


_LATTICES: dict = {}


def _lattice(shared) -> Lattice:
    """The broadcast model's lattice, built once a worker."""
    if shared.value[0] not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[shared.value[0]] = Lattice(*shared.value[1:])
    return _LATTICES[shared.value[0]]


def _share(spark: SparkSession, pieces: list[bytes], weights):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().hex, pieces, weights))


def _slices(words, size=len):
    """Lists of ``words`` of about FLAT_BYTES."""
    part, total = [], 0
    for w in words:
        part.append(w)
        total += size(w)
        if total >= FLAT_BYTES:
            yield part
            part, total = [], 0
    if part:
        yield part


def _expectations(shared):
    """A mapInArrow function: words to expected uses of pieces in a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        lattice = _lattice(shared)
        total = np.zeros(len(lattice.weights))
        for b in batches:
            # a long word counts as the words that it is cut into
            words = (w[i:i + LONG] for w in b.column(0).to_pylist() for i in range(0, len(w), LONG))
            for part in _slices(words):
                total += lattice.expected(part)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])
    return run


def fit(lexicon: DataFrame, prior: dict[bytes, float], rounds: int = ROUNDS, pseudo: float = PRIOR):
    """(pieces, log weights): from the vocabulary's scores, ``rounds`` of expectation
    maximisation over the distinct training words (column ``word``); only one sum
    for each piece comes to the driver."""
    import numpy as np

    spark = lexicon.sparkSession
    pieces = sorted(prior)
    start = np.exp(normalised(pieces, np.exp([prior[p] for p in pieces])))
    weights = np.log(start)
    for _ in range(rounds):
        shared = _share(spark, pieces, weights)
        uses = lexicon.select("word").mapInArrow(_expectations(shared), "piece int, uses double") \
            .groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        mass = start * pseudo / 2
        mass[uses["piece"].to_numpy(dtype=np.int64)] += uses["uses"].to_numpy()
        weights = normalised(pieces, mass)
        shared.unpersist()
    return pieces, weights


def _spelled(shared):
    """A mapInArrow function: (word, ..) to the other columns with the spelling's
    log probability. Rows come by word, so equal words are neighbours."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        lattice = _lattice(shared)
        for b in batches:
            runs = b.column(0).to_pylist()
            new = np.array([i == 0 or w != runs[i - 1] for i, w in enumerate(runs)], dtype=bool)
            words = [runs[i] for i in np.flatnonzero(new)]
            out = np.zeros(len(words))
            short = [i for i, w in enumerate(words) if len(w) < LONG]
            for part in _slices(short, lambda i: len(words[i])):
                out[part] = lattice.marginals([words[i] for i in part])
            for i, w in enumerate(words):
                if len(w) >= LONG:
                    out[i] = lattice.long_marginal(w)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out[np.cumsum(new) - 1] if len(new) else out)],
                                             [*b.schema.names[1:], "spelling"])
    return run


def held_out(id_: Column) -> Column:
    """Rows that the model does not learn from: crc32 of the id as text, mod 7, is
    2. A row without an id is learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _blocks(batches):
    """Rows (id, held_out, text) to block, id, held_out and the text as numbers of
    the block's words, and a row for each of these: number, word, training count."""
    import array
    import secrets

    import numpy as np
    import pyarrow as pa

    names = ["block", "id", "held_out", "numbers", "number", "word", "n"]

    def block(rows):
        name, number = secrets.randbits(63), defaultdict(itertools.count().__next__)
        texts = [array.array("I", map(number.__getitem__, words_of(t.as_buffer().to_pybytes()))).tobytes() for t in rows.column(2)]
        train = np.zeros(len(number), dtype=np.int64)
        for held, own in zip(rows.column(1).to_pylist(), texts):
            if not held:
                np.add.at(train, np.frombuffer(own, dtype=np.uint32), 1)
        n, k = rows.num_rows, len(number)
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * n, pa.int64()), rows.column(0), rows.column(1), pa.array(texts, pa.binary()),
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * k, pa.int64()), pa.nulls(k, rows.column(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()),
            pa.array(np.arange(k, dtype=np.int32)), pa.array(number, pa.binary()), pa.array(train)], names)

    for b in batches:
        at = total = 0
        for i, t in enumerate(b.column(2)):
            size = len(t.as_buffer())
            if total and total + size > BLOCK_BYTES:
                yield from block(b.slice(at, i - at))
                at, total = i, 0
            total += size
        if b.num_rows > at:
            yield from block(b.slice(at))


def _measures(totals):
    """A cogroup function: a block's documents and its words' figures to scores."""
    tokens, distinct, words, kinds, ends, discount = totals

    def run(docs, figures):
        import numpy as np
        import pyarrow as pa

        order = figures.column("number").to_numpy()
        c, spelling = np.zeros(len(order) + 1), np.zeros(len(order) + 1)       # the end is the last
        c[order], spelling[order] = figures.column("c").to_numpy(), figures.column("spelling").to_numpy()
        c[-1] = ends
        base = np.log10((c + 1) / (tokens + distinct + 1))
        stop = (ends + 0.5) / (tokens + 1)                  # a text may end before it has a word
        if words:
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / words)
            model = np.logaddexp(whole, math.log(discount * kinds / words) + spelling)
        else:
            model = spelling
        model = (model + math.log1p(-stop)) / math.log(10)
        model[-1] = math.log10(stop)
        known = c > 0
        rows = []
        for own in docs.column("numbers"):
            at = np.append(np.frombuffer(own.as_buffer(), dtype=np.uint32), np.uint32(len(order)))
            rows.append((len(at), int(known[at].sum()), int(tokens), float(base[at].sum()), float(model[at].sum())))
        kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([docs.column("id"), docs.column("held_out"), *[pa.array(x, t) for x, t in zip(zip(*rows), kinds_)]],
                                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS, ranks: bool = True,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens (words and one
    end), n_known (tokens seen in training), train_tokens, base_score (log10 under
    add-one counts) and score (log10 probability of the text under the lattice).

    NULL and wordless texts are an end alone. Repeated rows are learned from and
    scored each; an id only says whether a row is held out, NULL ids are not. With
    nothing to learn from, the vocabulary's scores stand alone. An empty table
    gives no rows; other columns of the input are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_ = F.col(f"`{id_col}`")
    kind = docs.select(id_).schema[0].dataType.simpleString()
    rows = docs.select(id_.alias("id"), held_out(id_).alias("held_out"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(_blocks, f"block long, id {kind}, held_out boolean, numbers binary, number int, word binary, n long"), "lm-blocks")
    texts = blocks.where("numbers IS NOT NULL").select("block", "id", "held_out", "numbers")
    # one exchange by word: at most one row a block for the most common one
    word = Window.partitionBy("word")
    used = written(blocks.where("word IS NOT NULL").select(
        "word", F.col("block").alias("of"), "number", F.sum("n").over(word).alias("c"),
        (F.col("block") == F.min("block").over(word)).alias("first")), "lm-words")
    trained = used.where("first AND c > 0")
    n = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)),
                    F.count(F.when(F.col("c") == 2, 1))).first()
    ends = texts.where("NOT held_out").count()
    discount = n[2] / (n[2] + 2 * n[3]) if n[2] and n[3] else 0.5
    totals = (n[0] + ends, n[1] + (1 if ends else 0), n[0], n[1], ends, discount)
    model = _share(spark, *fit(trained, vocabulary(vocabulary_path, ranks), rounds if n[1] else 0))
    figures = used.select("word", "of", "number", "c").mapInArrow(_spelled(model), "of long, number int, c long, spelling double")
    return (texts.groupBy("block").cogroup(figures.groupBy("of"))
            .applyInArrow(_measures(totals), f"id {kind}, held_out boolean, n_tokens long, n_known long, "
                                             "train_tokens long, base_score double, score double")
            .withColumnRenamed("id", "doc_id"))
