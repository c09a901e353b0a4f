"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, over texts of any length.

Tokenizer A is a byte-level BPE file of the tokenizers library and reads a space and the text; B is a SentencePiece model,
which adds that space itself. Byte offsets at which a token of either ends cut both sequences into groups; the last A and the
last B token of a group are linked. Tokens are kept as ids with their byte lengths, so ends are prefix sums.

A fragment is what a byte range of a text holds: the open tokens up to its first common end, closed groups, and the open
tokens after its last common end. Fragments of neighbouring ranges compose: the open end of one and the open start of the
next close a group if both ranges hold a common end, and stay open otherwise. Composition is associative, so a text of many
ranges is reduced as a tree: FAN neighbours at a time are grouped and folded by a Spark job per level. Only open tokens
travel up the tree; closed groups stay in the table of ranges, and a group that a fold closes is put out with its place.

Texts of up to LONG bytes are whole ranges, taken many to a block where Spark read them. Longer ones are cut into ranges of
about RANGE bytes, dealt over tasks, where A surely begins a token (pieces.cut); B's tokens may reach over such a cut, so a
range carries the text to the next places at which B surely begins a token, at most RANGE bytes off (a cut without such
places near is not used: a run without spaces is one unit for B, and one range).

A block numbers its distinct id pairs and keeps, for each link, its pair's number; pairs are counted over the corpus, joined
back to the blocks by pair (a row a block and pair, so no key is hot), and summed per text with numpy.

Defined cases: texts that are null, empty, or whose joined bytes of A or B differ from the space and the text have no
tokens: zeros, and an empty hash; their links count nowhere; the strings of special tokens are plain text; rows that repeat
an id are documents of their own, null ids stay null; an empty table gives an empty result; columns beside the id and the
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.pieces import PieceTable, cut, gather
from lapwise.llm.scratch import small_batches, temporary, written
from lapwise.llm.token_files import PieceTokenizer
from lapwise.llm.workers import held

LONG, RANGE, BLOCK = 1 << 20, 256 << 10, 512 << 10
FAN = 16
PIECES_KEPT, ITEMS = 400_000, 1 << 16
FRAGMENT = "valid boolean, first long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>"
SEAM = "struct<pos:long,text:string,pair:long>"


def space_cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each row, and of each run of spaces after another byte: no piece of B reaches from that byte into a space."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        space = data == 0x20
        begin[1:-1] = space[1:] & ~space[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin[:-1])


class SpaceTable(PieceTable):
    """Ids of the pieces that space_cut gives."""

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = space_cut(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        number = self._numbers(pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]))
        begin = self.ends[number]
        sizes = self.ends[number + 1] - begin
        return gather(self.flat, begin, sizes), np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


class Spelling:
    """The bytes of a tokenizer's tokens, one after another, and a check that tokens spell their pieces."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled, self.flat = spelled, np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array(list(map(len, spelled)), dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def proven(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and how many each piece has; a piece that its tokens do not spell has the one id -1."""
        sizes = self.sizes[ids]
        spelled = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        whole = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        if np.array_equal(spelled, np.cumsum(list(map(len, pieces)))) and np.array_equal(gather(self.flat, self.begin[ids], sizes), whole):
            return ids, counts
        stops, out, new = np.cumsum(counts), [], counts.copy()
        for k, (piece, a, b) in enumerate(zip(pieces, (stops - counts).tolist(), stops.tolist(), strict=True)):
            own = ids[a:b].tolist()
            if b"".join([self.spelled[i] for i in own]) != piece:
                own, new[k] = [-1], 1
            out.append(own)
        return np.fromiter(chain.from_iterable(out), dtype=np.int32), new


def byte_letters() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write for them: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PlainTokenizer(PieceTokenizer):
    """Tokenizer A: strings of special tokens are plain text; ids of what its tokens do not spell are -1."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tool.encode_special_tokens = True
        self.added, letters = [], byte_letters()
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            spelled[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.spelling = Spelling(spelled)
        self.table = PieceTable(self._sure, PIECES_KEPT, 16 << 20)

    def _sure(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.spelling.proven(pieces, *self._learn(pieces))


class SpacePieces:
    """Tokenizer B on pieces that begin with a space: the model puts that space before each piece itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.tool = SentencePieceProcessor(model_file=path)
        names = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of this model reaches into a space, so texts cannot be cut there")
        self.spelling = Spelling([bytes([int(name[3:5], 16)]) if self.tool.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)])
        self.space = self.tool.piece_to_id("▁")
        self.table = SpaceTable(self._sure, PIECES_KEPT, 16 << 20)

    def _sure(self, pieces: list[bytes], count: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = []
        for at in range(0, len(pieces), count):
            found += self.tool.encode([p[1:].decode() for p in pieces[at : at + count]], num_threads=1)
        found = [own if len(piece) > 1 else [self.space] for piece, own in zip(pieces, found, strict=True)]
        return self.spelling.proven(pieces, np.fromiter(chain.from_iterable(found), dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64))


class Aligner:
    """Both tokenizers and the tables that numpy needs: byte lengths of tokens, and decimals with a place for a mark behind."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = PlainTokenizer(path_a), SpacePieces(path_b)
        self.length_a, self.length_b = self.a.spelling.sizes, self.b.spelling.sizes
        decimals = [b"%d," % i for i in range(max(len(self.length_a), len(self.length_b)))]
        self.decimal, self.wide = np.frombuffer(b"".join(decimals), dtype=np.uint8), np.array(list(map(len, decimals)), dtype=np.int64)
        self.decimal_at = np.cumsum(self.wide) - self.wide

    def close(self) -> None:
        self.a.table.clear()
        self.b.table.clear()

    def groups_text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups' text, a semicolon behind each group, and where each group's text ends. last: the token ends its group."""
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        before_b = np.concatenate([[0], at_b + 1])[np.cumsum(last_a) - last_a]
        through_a = (at_a + 1)[np.cumsum(last_b) - last_b]
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + through_a
        items, marks = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.uint8)
        items[place_a], items[place_b] = a, b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        out = np.concatenate([gather(self.decimal, self.decimal_at[part], self.wide[part]) for part in np.split(items, range(ITEMS, len(items), ITEMS))])  # in parts: gather's indices are large
        ends = np.cumsum(self.wide[items])
        out[ends - 1] = marks
        return out, ends[place_b[at_b]]

    def ends(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.cumsum(lengths[tokens])


def together(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each A token, and each B token, ends where a token of the other does. size: above all ends."""
    mark = np.zeros(size + 1, dtype=bool)
    mark[ends_a] = True
    last_b = mark[ends_b]
    mark[:] = False
    mark[ends_b] = True
    return mark[ends_a], last_b


def packed_links(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct pairs, how often each occurs, and the links as numbers of pairs."""
    distinct, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    return distinct, counts, zstandard.ZstdCompressor(level=1).compress(number.astype("<u4").tobytes())


def one_list(values: np.ndarray | list, kind: pa.DataType) -> pa.ListArray:
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def with_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a space before each row that is not empty."""
    full = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(full)])
    out = np.full(len(data) + shift[-1], 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
    return out, offsets + shift


def whole_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per block of whole texts: per document its counts and hash, and all links as numbers of distinct pairs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        for part, raw, raw_offsets in tb.text_blocks(batches, "text", BLOCK):
            data, offsets = with_spaces(raw, raw_offsets)
            (a, cut_a), (b, cut_b) = tool.a.table.encode(data, offsets), tool.b.table.encode(data, offsets)
            row_a, row_b = np.repeat(np.arange(part.num_rows), np.diff(cut_a)), np.repeat(np.arange(part.num_rows), np.diff(cut_b))
            valid = np.ones(part.num_rows, dtype=bool)
            valid[row_a[a < 0]] = valid[row_b[b < 0]] = False
            a, b, row_a, row_b = a[valid[row_a]], b[valid[row_b]], row_a[valid[row_a]], row_b[valid[row_b]]
            last_a, last_b = together(tool.ends(a, tool.length_a), tool.ends(b, tool.length_b), len(data))
            n_a, n_b, n_groups = (np.bincount(rows, minlength=part.num_rows) for rows in (row_a, row_b, row_b[last_b]))
            text, ends = tool.groups_text(a, b, last_a, last_b)
            stops = np.concatenate([[0], ends])[np.cumsum(n_groups)]
            text, starts = text.tobytes(), np.concatenate([[0], stops[:-1]])
            hashes = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
            pairs, counts, links = packed_links(a[last_a].astype(np.int64) << 32 | b[last_b])
            ids = part.column("id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([True]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(one_list(x, pa.int64()) for x in (n_a, n_b, n_groups)), one_list(hashes, pa.string()), one_list(pairs, pa.int64()), one_list(counts, pa.int64()), pa.array([links], pa.binary())],
                names=["whole", "ids", "n_a", "n_b", "n_groups", "hashes", "pairs", "counts", "links"],
            )

    lists = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups"))
    return docs.select("id", "text").mapInArrow(run, f"whole boolean, ids array<{kind}>, {lists}, hashes array<string>, pairs array<long>, counts array<long>, links binary")


def ranges(docs: DataFrame, size: int) -> DataFrame:
    """row, seq, slice, begin and stop (of the range in the slice) of long texts (row, text), a space put before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, raw_offsets in tb.text_blocks(batches, "text", 0):
            data, offsets = with_spaces(raw, raw_offsets)
            places, safe = cut(data, offsets)[0], np.append(space_cut(data, offsets), len(data))
            low, high = safe[np.searchsorted(safe, places, side="right") - 1], safe[np.searchsorted(safe, places)]
            near = places[high - low <= size]
            bounds = [0]
            while (k := int(np.searchsorted(near, bounds[-1] + size))) < len(near):
                bounds.append(int(near[k]))
            bounds.append(len(data))
            for seq, (begin, stop) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                first, last = safe[np.searchsorted(safe, begin, side="right") - 1], safe[np.searchsorted(safe, stop)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([seq], pa.int64()), pa.array([data[first:last].tobytes()], pa.binary()), pa.array([begin - first], pa.int64()), pa.array([stop - first], pa.int64())], names=["row", "seq", "slice", "begin", "stop"])

    return docs.select("row", "text").mapInArrow(run, "row long, seq long, slice binary, begin long, stop long")


@dataclass
class Fragment:
    """What a byte range holds beside closed groups. first: the range in which its first common end lies; None: it has none, and all its tokens are the prefix."""

    valid: bool
    first: int | None
    prefix: tuple[list[int], list[int]]
    suffix: tuple[list[int], list[int]]

    def then(self, other: Fragment) -> tuple[Fragment, dict | None]:
        """This fragment and the one of the range behind it as one, and the group that closes between them."""
        join = lambda x, y: (x[0] + y[0], x[1] + y[1])
        valid = self.valid and other.valid
        if self.first is None:
            return Fragment(valid, other.first, join(self.prefix, other.prefix), other.suffix), None
        if other.first is None:
            return Fragment(valid, self.first, self.prefix, join(self.suffix, other.prefix)), None
        return Fragment(valid, self.first, self.prefix, other.suffix), closed_group(other.first, *join(self.suffix, other.prefix))


def closed_group(pos: int, a: list[int], b: list[int]) -> dict:
    return {"pos": pos, "text": ",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";", "pair": a[-1] << 32 | b[-1]}


def fragments(parts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, node, the fragment, its numbers of tokens, and its closed groups as text and links, of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("slice")[i].as_buffer(), dtype=np.uint8)
                seq, begin, stop = (batch.column(c)[i].as_py() for c in ("seq", "begin", "stop"))
                inner = data[begin:stop]
                a, b = tool.a.table.encode(inner, np.array([0, len(inner)]))[0], tool.b.table.encode(data, np.array([0, len(data)]))[0]
                valid = bool((a >= 0).all() and (b >= 0).all())
                if not valid:
                    a, b = a[:0], b[:0]
                ends_a, ends_b = begin + tool.ends(a, tool.length_a), tool.ends(b, tool.length_b)
                inside = (ends_b > begin) & (ends_b <= stop)
                b, ends_b = b[inside], ends_b[inside]
                last_a, last_b = together(ends_a, ends_b, len(data))
                at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
                cut_ = len(at_a) > 0
                lo_a, hi_a, lo_b, hi_b = (at_a[0] + 1, at_a[-1] + 1, at_b[0] + 1, at_b[-1] + 1) if cut_ else (len(a), len(a), len(b), len(b))
                text = tool.groups_text(a[lo_a:hi_a], b[lo_b:hi_b], last_a[lo_a:hi_a], last_b[lo_b:hi_b])[0].tobytes() if hi_a > lo_a else b""
                pairs, counts, links = packed_links(a[at_a[1:]].astype(np.int64) << 32 | b[at_b[1:]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, 1), pa.array([seq]), pa.array([valid]), pa.array([seq if cut_ else None], pa.int64()), *(one_list(x, pa.int32()) for x in (a[:lo_a], b[:lo_b], a[hi_a:], b[hi_b:])), pa.array([len(a)], pa.int64()), pa.array([len(b)], pa.int64()), pa.array([max(0, len(at_a) - 1)], pa.int64()), pa.array([squeeze.compress(text)], pa.binary()), one_list(pairs, pa.int64()), one_list(counts, pa.int64()), pa.array([links], pa.binary())],
                    names=["row", "node", "valid", "first", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "n_a", "n_b", "n_groups", "text", "pairs", "counts", "links"],
                )

    return parts.mapInArrow(run, f"row long, node long, {FRAGMENT}, n_a long, n_b long, n_groups long, text binary, pairs array<long>, counts array<long>, links binary")


def folded(level: DataFrame) -> DataFrame:
    """One level of the tree: FAN neighbours composed, and the groups that this closes as seams."""
    fields = [f.split()[0] for f in FRAGMENT.split(", ")]
    grouped = level.groupBy("row", F.floor(F.col("node") / FAN).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", *fields))).alias("children"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole, seams = None, []
                for c in row["children"]:
                    one = Fragment(c["valid"], c["first"], (c["prefix_a"], c["prefix_b"]), (c["suffix_a"], c["suffix_b"]))
                    whole, seam = (one, None) if whole is None else whole.then(one)
                    if seam:
                        seams.append(seam)
                out = {"row": row["row"], "node": row["parent"], "valid": whole.valid, "first": whole.first, "prefix_a": whole.prefix[0], "prefix_b": whole.prefix[1], "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1], "seams": seams}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("row", pa.int64()), ("node", pa.int64()), ("valid", pa.bool_()), ("first", pa.int64()), *((c, ints) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")), ("seams", pa.list_(pa.struct([("pos", pa.int64()), ("text", pa.string()), ("pair", pa.int64())])))])
    return grouped.mapInArrow(run, f"row long, node long, {FRAGMENT}, seams array<{SEAM}>")


def reduced(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every long text: row and whether it is valid; and its seams as row, pos, text, pair."""
    top = leaves.agg(F.max("node")).first()[0] or 0
    level, seams = leaves, []
    while True:
        level = written(folded(level), "fragment-level")
        seams.append(level.where(F.size("seams") > 0).select("row", F.explode("seams").alias("s")).select("row", "s.*"))
        if top < FAN:
            break
        top //= FAN
    first = level.where("valid AND first IS NOT NULL")  # what stands before the first common end is the first group
    begun = first.select("row", F.col("first").alias("pos"), F.concat(F.array_join("prefix_a", ","), F.lit("|"), F.array_join("prefix_b", ","), F.lit(";")).alias("text"), (F.shiftleft(F.element_at("prefix_a", -1).cast("long"), 32) + F.element_at("prefix_b", -1)).alias("pair"))
    for s in seams:
        begun = begun.unionByName(s)
    return level.select("row", "valid"), begun


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, n (links of the corpus that hold it) and best (no pair of its b has more)."""
    counts = written(blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")), "pair-counts")
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", F.shiftright("pair", 32).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """block, number of a document in it, n_best and count_sum. blocks: block, n_groups (a list), pairs, links."""
    asked = blocks.select("block", F.posexplode("pairs").alias("k", "pair"))
    known = asked.join(counts.select("pair", "n", "best"), "pair").groupBy("block").agg(F.collect_list(F.struct("k", "n", "best")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                links = np.frombuffer(unpack.decompress(batch.column("links")[i].as_buffer()), dtype="<u4")
                known = batch.column("known")[i].values
                k = known.field("k").to_numpy()
                n, best = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
                n[k], best[k] = known.field("n").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
                stops = np.concatenate([[0], np.cumsum(batch.column("n_groups")[i].values.to_numpy())])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[stops]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stops) - 1, batch.column("block")[i].as_py())), pa.array(np.arange(len(stops) - 1)), *map(pa.array, sums)], names=["block", "at", "n_best", "count_sum"])

    return blocks.select("block", "n_groups", "links").join(known, "block").mapInArrow(run, "block long, at long, n_best long, count_sum long")


def ordered_hashes(parts: DataFrame) -> DataFrame:
    """row and the hash of its groups' text: parts (row, pos, part, text) in order, streamed, so that no text is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, row, state, behind = zstandard.ZstdDecompressor(), None, None, b""
        done = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([state.hexdigest()])], names=["row", "groups_sha256"])
        for batch in batches:
            for own, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                if own != row:
                    if state is not None:
                        yield done()
                    row, state, behind = own, hashlib.sha256(), b""
                if text := unpack.decompress(text.as_buffer()):
                    state.update(behind + text[:-1])  # the last semicolon waits for a group behind it
                    behind = text[-1:]
        if state is not None:
            yield done()

    return parts.repartition("row").sortWithinPartitions("row", "pos", "part").select("row", "text").mapInArrow(run, "row long, groups_sha256 string")


def squeezed(column: str):  # noqa: ANN201
    """Texts of seams as the ranges' texts are held."""

    @F.pandas_udf("binary")
    def run(texts):  # noqa: ANN001, ANN202
        pack = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: pack.compress(t.encode()))

    return run(column)


def align(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", long: int = LONG, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the corpus's pairs: a, b, n, best."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    with temporary(spark):
        whole = written(whole_blocks(rows.where(~is_long), path_a, path_b), "aligned-blocks")
        with small_batches(spark):
            numbered = written(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
            parts = written(ranges(numbered, size).repartition("row", "seq"), "text-ranges")
            leaves = written(fragments(parts, path_a, path_b), "fragments")
            valid, seams = reduced(leaves)
            sound = valid.where("valid").select("row")
            closed = leaves.join(sound, "row").select("row", F.col("node").alias("pos"), F.lit(1).alias("part"), "n_a", "n_b", "n_groups", "text", "pairs", "counts", "links")
            one = F.lit(zstandard.ZstdCompressor(level=1).compress(np.zeros(1, dtype="<u4").tobytes()))
            zero = F.lit(0).cast("long")
            joined = seams.join(sound, "row").select("row", "pos", F.lit(0).alias("part"), zero.alias("n_a"), zero.alias("n_b"), F.lit(1).cast("long").alias("n_groups"), squeezed("text").alias("text"), F.array("pair").alias("pairs"), F.array(F.lit(1).cast("long")).alias("counts"), one.alias("links"))
            pieces = written(closed.unionByName(joined), "long-pieces")
            blocks = whole.select(F.lit(None).cast("long").alias("row"), "n_groups", "pairs", "counts", "links", "ids", "n_a", "n_b", "hashes").unionByName(
                pieces.select("row", F.array("n_groups").alias("n_groups"), "pairs", "counts", "links"), allowMissingColumns=True
            )
            blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "numbered-blocks")
            counts = written(pair_counts(blocks), "pair-table", lasting=True)
            sums = written(summed(blocks, counts), "link-sums")
            hashes = written(ordered_hashes(pieces.select("row", "pos", "part", "text")), "long-hashes")
            places = blocks.where("ids IS NOT NULL").select("block", F.posexplode(F.arrays_zip("ids", "n_a", "n_b", "n_groups", "hashes")).alias("at", "d"))
            short = places.join(sums, ["block", "at"], "left").select(F.col("d.ids").alias(key), "d.n_a", "d.n_b", "d.n_groups", F.col("d.n_groups").alias("n_links"), "n_best", "count_sum", F.col("d.hashes").alias("groups_sha256"))
            totals = pieces.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")])
            linked = blocks.where("row IS NOT NULL").select("block", "row").join(sums, "block").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
            far = numbered.select("row", F.col("id").alias(key)).join(totals, "row", "left").join(linked, "row", "left").join(hashes, "row", "left")
            far = far.select(key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
            found = short.unionByName(far)
            counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
            result = written(found.select(key, *counted, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), "alignment", lasting=True)
    return result, counts.select("a", "b", "n", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
