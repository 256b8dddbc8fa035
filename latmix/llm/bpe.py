"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Encoding: a text is cut by the pre-tokenizer's pattern into words; a word's byte array is folded by
ranked merges. The ranks are a literal of the plan: for each pair (left id, right id) that merges
into a token, TABLE[SHIFT[left] + right] holds the left id and the token (rows of a sparse matrix
laid over each other), so one array access finds a pair's rank.

Distinct words are folded, not occurrences. Words are counted over all documents (with partial
counts, no word is hot), and those counted most, at most MOST of them and twice at least, are folded
once and go to the tasks as a table of bounded size. A task works on blocks of about PART words: the
distinct words of a block that the table lacks are folded by the block, and the words of its texts
are looked up among both. The table decides about time only, never about results. No text is shuffled.

The pattern's classes are those of the tokenizer's engine: what its Unicode version has and Java's
lacks is asked of both and written into the pattern.

Decoding concatenates the ids' pieces. In expressions pieces are kept as Latin-1 strings, one
character a byte, as only strings can be joined in linear time.

Null or empty text: no ids. Repeated rows: each is encoded. An empty table: no rows. Columns that are
not asked for are ignored, whatever their names. A word of very many bytes (an unbroken run of
letters) takes time in proportion to its length times the number of different merges in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, give_back, lean, table, text_or_empty, unused

#: Words of the table at most; words of a block, unless one text has more: its row stays small for the JVM's heap.
MOST, PART = 1 << 21, 1 << 16
#: Longer words are folded by rounds that merge all occurrences of a pair at once.
SHORT = 32
NONE = 1 << 16


class Ranks:
    """A rank file as arrays for literals."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        assert max(self.ranks.values()) < NONE - 1, "ids must fit 16 bits"
        self.pieces = [""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece.decode("latin-1")
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.shift, self.table = self._lay(self._pairs())
        self.ranks = None

    def _pairs(self) -> dict[int, dict[int, int]]:
        """The one pair from which merging by rank makes each token."""
        rows: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NONE))
                if self.ranks.get(parts[best] + parts[best + 1], NONE) >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                rows.setdefault(self.ranks[parts[0]], {})[self.ranks[parts[1]]] = rank
        return rows

    def _lay(self, rows: dict[int, dict[int, int]]) -> tuple[list[int], list]:
        """Rows laid over each other at random shifts, fullest first; no entry: None."""
        width = len(self.pieces)
        size = 4 * width
        out, shift, rng = np.full(size, -1, np.int64), [0] * width, np.random.default_rng(0)
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            cols, at = np.fromiter(row, np.int64), 0
            while (out[at + cols] >= 0).any():
                at = int(rng.integers(size - width))
            out[at + cols] = [left << 16 | v for v in row.values()]
            shift[left] = at
        return shift, [None if v < 0 else v for v in out.tolist()]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def constant(one: DataFrame) -> Column:
    """The value of a frame of one row and one column as a literal.

    The literal holds Spark's binary array itself, so the optimizer compares and ships it as bytes;
    an array literal written out in a query of this size would take it many seconds.
    """
    jvm = one.sparkSession.sparkContext._jvm
    row = one._jdf.queryExecution().executedPlan().executeCollect()[0]
    kind = one._jdf.schema().apply(0).dataType()
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.get(0, kind), kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


class Tables:
    """A rank file's arrays as literals; their size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, rank_path: str):
        ranks, scratch = ranks_of(rank_path), Scratch(spark, "ranks")
        row = spark.createDataFrame([(ranks.shift, ranks.table, ranks.pieces, ranks.bytes)], "shift array<int>, merged array<bigint>, pieces array<string>, first array<int>")
        stored = scratch.keep(row.coalesce(1), "tables")
        self.shift, self.merged, self.pieces, self.first = (constant(stored.agg(F.first(c).alias(c))) for c in ("shift", "merged", "pieces", "first"))
        self.latin = ranks.pieces
        scratch.drop("tables")


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def of_engine(kind: str) -> frozenset[str]:
    """The characters of a class such as \\p{L}, as the tokenizer's engine has it: it returns what a pattern matches."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    engine = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(bytes(engine.encode_ordinary(every)).decode())


def ranges(chars) -> str:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


@lru_cache(maxsize=8)
def java_class(spark: SparkSession, kind: str) -> str:
    """A class that Java matches as the engine does; it stands alone and inside brackets."""
    java = {r"\s": r"\p{IsWhite_Space}"}.get(kind, kind)
    want = of_engine(kind)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    have = set(spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"[^{java}]+").matcher(every).replaceAll(""))
    more, less = want - have, have - want
    if more:
        # the outer range is tried first, and few characters lie in it
        java = rf"[{java}[\x{{{ord(min(more)):X}}}-\x{{{ord(max(more)):X}}}&&[{ranges(more)}]]]"
    return f"[{java}&&[^{ranges(less)}]]" if less else java


def java_pattern(spark: SparkSession, pattern: str) -> str:
    def bracket(m) -> str:
        """A negated bracket of classes: none of them, one by one, as Java's negation of nested classes differs by version."""
        kinds, rest = re.findall(r"\\p\{\w+\}|\\s", m[1]), re.sub(r"\\p\{\w+\}|\\s", "", m[1])
        return "(?:" + "".join(f"(?!{java_class(spark, k)})" for k in kinds) + (f"[^{rest}])" if rest else r"[\x{0}-\x{10FFFF}])")

    # \S and \P are the complements
    one = lambda m: java_class(spark, m[0]) if m[0][1] in "sp" else f"(?:(?!{java_class(spark, m[0].lower() if m[0] == chr(92) + 'S' else m[0].replace('P', 'p', 1))})[\\x{{0}}-\\x{{10FFFF}}])"
    parts = re.split(r"(\[\^[^\]]*\])", pattern)
    return "".join(bracket(re.fullmatch(r"\[\^([^\]]*)\]", p)) if p.startswith("[^") else re.sub(r"\\[pP]\{\w+\}|\\[sS]", one, p) for p in parts)


def pre_tokens(spark: SparkSession, text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(spark, pattern)), F.lit(0))


def fold_word(word: Column, tables: Tables) -> Column:
    """array<int>: the ids of one word."""
    shift, merged, first = tables.shift, tables.merged, tables.first
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    begin = F.transform(F.split(latin, ""), lambda c: F.get(first, F.ascii(c)))

    def rank(left: Column, right: Column) -> Column:
        """The token that the pair makes, NONE or more if it makes none, null if one is missing."""
        return F.get(merged, F.get(shift, left) + right).bitwiseXOR(F.shiftleft(left.cast("bigint"), 16))

    def ranked(ids: Column) -> Column:
        return F.transform(ids, lambda l, i: rank(l, F.get(ids, i + 1)))

    def shortly() -> Column:
        """One merge a round. Nulls at both ends of the ids; ranks[i] is that of ids[i] and ids[i + 1]."""

        def step(acc, _):
            ids, ranks = acc["ids"], acc["ranks"]

            def merge(best):
                token = best.cast("int")

                def at(p):
                    around = F.array(rank(F.get(ids, p - 2), token), rank(token, F.get(ids, p + 1)))
                    return F.struct(
                        F.concat(F.slice(ids, F.lit(1), p - 1), F.array(token), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                        F.concat(F.slice(ranks, F.lit(1), p - 2), around, F.slice(ranks, p + 2, F.size(ranks))).alias("ranks"),
                        F.lit(False).alias("done"),
                    )

                stop = F.struct(ids.alias("ids"), ranks.alias("ranks"), F.lit(True).alias("done"))
                return F.when(best < NONE, let(F.array_position(ranks, best).cast("int"), at)).otherwise(stop)

            return F.when(acc["done"], acc).otherwise(let(F.array_min(ranks), merge))

        padded = F.concat(F.array(F.lit(None).cast("int")), begin, F.array(F.lit(None).cast("int")))
        start = let(padded, lambda ids: F.struct(ids.alias("ids"), ranked(ids).alias("ranks"), (F.size(ids) < 4).alias("done")))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step, lambda acc: F.slice(acc["ids"], F.lit(2), F.size(acc["ids"]) - 2))

    def merge_all(ids: Column, found: Column, best: Column) -> Column:
        # of overlapping pairs, as in a run of one letter, every other one from the left
        flags = F.array_join(F.transform(found, lambda r: F.when(r == best, "1").otherwise("0")), "")
        flags = F.split(F.replace(flags, F.lit("11"), F.lit("10")), "")
        pairs = F.arrays_zip(ids.alias("id"), flags.alias("flag"), F.concat(F.array(F.lit("0")), flags).alias("before"))
        kept = F.filter(pairs, lambda x: (x["before"] == "0") & x["id"].isNotNull())
        return F.transform(kept, lambda x: F.when(x["flag"] == "1", best.cast("int")).otherwise(x["id"]))

    def at_length() -> Column:
        """A round merges all occurrences of the best pair."""

        def step(acc, _):
            ids = acc["ids"]
            stop = F.struct(ids.alias("ids"), F.lit(True).alias("done"))
            go = lambda found, best: F.when(best < NONE, F.struct(merge_all(ids, found, best).alias("ids"), F.lit(False).alias("done"))).otherwise(stop)
            return F.when(acc["done"], acc).otherwise(let(ranked(ids), lambda found: let(F.array_min(found), lambda best: go(found, best))))

        start = F.struct(begin.alias("ids"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step, lambda acc: acc["ids"])

    return F.when(F.octet_length(word) <= SHORT, shortly()).otherwise(at_length())


def _hashes(words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 makes of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


def _counts(batches):
    import pyarrow as pa

    for batch in batches:
        got = batch.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["word", "n"])


def _packed(batches):
    """A task's words and their ids as one row, in the order of their hashes."""
    import pyarrow as pa

    hashes, words, lengths, sizes, ids = [], [], [], [], []
    for batch in batches:
        word = batch.column("word").cast(pa.binary())
        hashes.append(batch.column("hash").to_numpy())
        words.append(b"".join(word.to_pylist()))
        lengths.append(np.diff(np.frombuffer(word.buffers()[1], np.int32, len(word) + 1, 4 * word.offset)))
        sizes.append(batch.column("ids").value_lengths().to_numpy().astype(np.int32))
        ids.append(batch.column("ids").flatten().to_numpy().astype(np.uint16))
    if words:
        cols = [*(np.concatenate(c).tobytes() for c in (hashes, lengths, sizes, ids)), b"".join(words)]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["hashes", "lengths", "sizes", "ids", "words"])


class Known:
    """The table of folded words, by hash: about 40 bytes a word. What finds words and what holds their ids go to different tasks.

    What goes to tasks are arrays: a broadcast is pickled by reference, and workers need not have this package.
    """

    def __init__(self, hashes: np.ndarray, text: np.ndarray, ends: np.ndarray):
        self.hashes, self.text, self.ends = hashes, text, ends

    @classmethod
    def of(cls, rows) -> "Known":
        """rows: in the order of their hashes. ids: those of all words, and where each word's begin."""
        read = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows]) if rows else np.zeros(0, kind)
        out = cls(read("hashes", np.int64), read("words", np.uint8), np.append(0, np.cumsum(read("lengths", np.int32), dtype=np.int64)))
        out.ids = read("ids", np.uint16), np.append(0, np.cumsum(read("sizes", np.int32))).astype(np.int32)
        return out

    def find(self, words) -> np.ndarray:
        """The number of each word of an Arrow array of distinct words, -1 for those not in the table."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = words.cast(pa.large_binary())
        out = np.full(len(words), -1, np.int64)
        if not len(self.hashes) or not len(words):
            return out
        h = _hashes(words.to_pylist())
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        own = pa.Array.from_buffers(pa.large_binary(), len(self.hashes), [None, pa.py_buffer(self.ends), pa.py_buffer(self.text)])
        # equal hashes are no proof
        same = pc.equal(own.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        out[hit[same]] = at[hit[same]]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that start so and are so long, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def known_words(docs: DataFrame, tables: Tables, pattern: str, most: int) -> Known:
    """The words counted most over all documents, each folded once; those counted once are left out."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "bpe")
    words = docs.select(pre_tokens(spark, text_or_empty(), pattern).alias("words"))
    counts = words.mapInArrow(lean(_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = scratch.keep(counts, "counts")
    rows, least = 0, 1 << 20
    for n, c in sorted(map(tuple, counts.groupBy(F.least("n", F.lit(least)).alias("n")).count().collect()), reverse=True):  # at most as many rows as there are counts
        if (rows := rows + c) > most:
            break
        least = n
    chosen = counts.where(F.col("n") >= least) if rows else counts
    packed = chosen.limit(0) if least == 1 << 20 and rows > most else chosen
    packed = packed.select(F.xxhash64("word").alias("hash"), "word").repartitionByRange("hash").sortWithinPartitions("hash")
    packed = packed.select("hash", "word", fold_word(F.col("word"), tables).alias("ids")).mapInArrow(lean(_packed), "hashes binary, lengths binary, sizes binary, ids binary, words binary")
    known = Known.of(packed.collect())  # at most so many words
    scratch.drop("counts")
    give_back()
    return known


def _coded(held, keep: list[str]):
    """Blocks of texts: the kept columns, words a text, the number of each word in the table or in the block's own list, and that list."""

    def run(batches):
        import pyarrow as pa

        known = Known(*held.value)
        for batch in batches:
            sizes = batch.column(len(keep)).value_lengths().to_numpy().astype(np.int64)
            block = np.cumsum(sizes) // PART
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(sizes) else []
            for a, b in zip(starts, [*starts[1:], len(sizes)]):
                part = batch.slice(a, b - a)
                words = part.column(len(keep)).flatten().dictionary_encode()
                number = known.find(words.dictionary)
                new = np.flatnonzero(number < 0)
                number[new] = -1 - np.arange(len(new))
                codes = number[words.indices.to_numpy()].astype(np.int32)
                kept = pa.RecordBatch.from_arrays(part.columns[: len(keep)], names=[f"c{i}" for i in range(len(keep))])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_batch(kept)
                own = words.dictionary.take(pa.array(new))
                own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in (sink.getvalue().to_pybytes(), sizes[a:b].tobytes(), codes.tobytes())), own], names=["kept", "sizes", "codes", "own"])

    return run


def _joined(held, keep: list[str], pieces: list[bytes] | None, with_ids: bool):
    """The ids of each text: of its words, one after the other. With pieces, their digests too."""

    def run(batches):
        import pyarrow as pa

        known, ends_of = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                kept = pa.ipc.open_stream(batch.column("kept")[k].as_py()).read_next_batch()
                sizes, codes = np.frombuffer(batch.column("sizes")[k].as_py(), np.int64), np.frombuffer(batch.column("codes")[k].as_py(), np.int32).astype(np.int64)
                own = batch.column("own")[k].values
                own_sizes = own.value_lengths().to_numpy().astype(np.int64)
                new = codes < 0
                number = np.where(new, 0, codes)
                starts, lengths = (ends_of[number], ends_of[np.minimum(number + 1, len(ends_of) - 1)] - ends_of[number])
                starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
                lengths[new] = own_sizes[-1 - codes[new]]
                starts[new] = (np.cumsum(own_sizes) - own_sizes)[-1 - codes[new]]
                at, of_own = spread(starts, lengths), np.repeat(new, lengths)
                ids = np.empty(len(at), np.uint32)
                ids[~of_own], ids[of_own] = known[at[~of_own]], own.flatten().to_numpy()[at[of_own]]
                ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes))]
                cols, names = list(kept.columns), list(keep)
                if pieces is not None:
                    parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
                    cols += [
                        pa.array(np.diff(ends)),
                        pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                        pa.array([hashlib.sha256(b"".join(map(pieces.__getitem__, p.tolist()))).hexdigest() for p in parts], pa.string()),
                    ]
                    names += DIGESTS
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode(docs: DataFrame, tables: Tables, pattern: str, *keep: str, digests: bool = False, ids: bool = True, most: int = MOST) -> DataFrame:
    """docs' columns ``keep`` and ``ids`` array<int>; with digests, the number of ids and the SHA-256 of
    the ids as little-endian 32-bit integers and of the bytes they decode to, before the ids."""
    spark = docs.sparkSession
    known = known_words(docs, tables, pattern, most)
    ids_of, held = spark.sparkContext.broadcast(known.ids), spark.sparkContext.broadcast((known.hashes, known.text, known.ends))
    del known
    words, = unused(keep, "words")
    blocks = docs.select(*keep, pre_tokens(spark, text_or_empty(), pattern).alias(words))
    blocks = blocks.mapInArrow(lean(_coded(held, list(keep))), "kept binary, sizes binary, codes binary, own array<string>")
    folded = blocks.select("kept", "sizes", "codes", F.transform("own", lambda w: fold_word(w, tables)).alias("own"))
    pieces = [p.encode("latin-1") for p in tables.latin] if digests else None
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + (["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else [])
    return folded.mapInArrow(lean(_joined(ids_of, list(keep), pieces, ids)), ", ".join(fields + ["ids array<int>"] * ids))


def decode(ids: Column, tables: Tables) -> Column:
    """binary: the concatenated pieces of the ids."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(tables.pieces, i)), ""), "ISO-8859-1")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = Tables(spark, path)
    return encode(docs, tables, public_tokenizers.PATTERN, "doc_id", digests=True, ids=False)


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
