"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its valid encoding. Storing
that last token per prefix gives the encoding of any prefix by walking back, makes appending bytes
exact, and lets an edit be re-encoded from the place of the edit until the stored tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import arrow_pass


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBpe:
    """Encoder and decoder over one rank table.

    A sequence of tokens is the valid encoding of its bytes if each token is valid alone and each two
    neighbours are. Merges run in the order of their ranks. Seen from the border of two tokens, the part
    left of it grows through the right spine of the left token's merges and the part right of it through
    the left spine of the right token's; the two stay apart if no two parts that meet at some moment
    have a joint rank below both next merges. (In a trained table a part has a lower rank than what it
    is merged into; a token without this property is decided by merging the joint bytes instead.)
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._parts: dict[int, tuple[int, int] | None] = {}
        # Sizes of the tokens that end in given bytes (three, or all there are), long to short.
        sizes: dict[bytes, set[int]] = {}
        for token, rank in ranks.items():
            if self.parts(rank) is not None:
                sizes.setdefault(token[-3:], set()).add(len(token))
        self._sizes = {end: sorted(found.union(*(sizes.get(end[i:], ()) for i in range(1, len(end)))),
                                   reverse=True) for end, found in sizes.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, bool], list[int] | None] = {}

    def merged(self, piece: bytes, but: bytes = b"") -> list[int]:
        """Tokens of a short byte string by merging the lowest-ranked neighbours first, never to `but`."""
        pieces = [piece[i:i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(pieces) > 1:
            joints = [left + right for left, right in zip(pieces, pieces[1:])]
            found = [sys.maxsize if joint == but else ranks.get(joint, sys.maxsize) for joint in joints]
            rank = min(found)
            if rank == sys.maxsize:
                break
            at = found.index(rank)
            pieces[at:at + 2] = [joints[at]]
        return [ranks[part] for part in pieces]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; (-1, -1) for a byte, None if no merges lead to it."""
        if token in self._parts:
            return self._parts[token]
        whole, found = self.bytes_of[token], None
        if len(whole) == 1:
            found = (-1, -1)
        else:
            halves = self.merged(whole, but=whole)  # stops just before the last merge
            if len(halves) == 2:
                found = (halves[0], halves[1])
        self._parts[token] = found
        return found

    def spine(self, token: int, right: bool) -> list[int] | None:
        """The outermost parts of a token from byte to whole; None if their ranks do not rise."""
        known = self._spines.get((token, right), 0)
        if known != 0:
            return known
        found: list[int] | None = []
        part = token
        while part != -1:
            found.append(part)
            halves = self.parts(part)
            if halves is None or max(halves) >= part and halves != (-1, -1):
                found = None
                break
            part = halves[right]
        if found is not None:
            found.reverse()
        self._spines[token, right] = found
        return found

    def _neighbours(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        grow_left, grow_right = self.spine(left, True), self.spine(right, False)
        names, ranks = self.bytes_of, self.ranks
        if grow_left is None or grow_right is None:
            return self.merged(names[left] + names[right]) == [left, right]
        i = j = 0
        last_i, last_j = len(grow_left) - 1, len(grow_right) - 1
        while True:
            next_left = grow_left[i + 1] if i < last_i else sys.maxsize
            next_right = grow_right[j + 1] if j < last_j else sys.maxsize
            joint = ranks.get(names[grow_left[i]] + names[grow_right[j]], sys.maxsize)
            # Of equal ranks the merge further left comes first.
            if joint < next_left and joint <= next_right and joint != sys.maxsize:
                return False
            if i == last_i and j == last_j:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the token that ends the encoding of data[:i]; extends the list of a shorter prefix."""
        last = [-1] if last is None else last
        known = len(last)
        last.extend([-1] * (len(data) + 1 - known))
        for end in range(known, len(data) + 1):
            if last[end] == -1:
                self._find_last(data, end, last)
        return last

    def _find_last(self, data: bytes, end: int, last: list[int]) -> int:
        """Store and return the last token of data[:end]; shorter prefixes are found where needed."""
        ranks, pairs = self.ranks, self._pairs
        sizes = self._sizes
        for size in (sizes.get(data[max(end - 3, 0):end]) or sizes.get(data[max(end - 2, 0):end])
                     or sizes.get(data[end - 1:end], ())):
            if size > end:
                continue
            token = ranks.get(data[end - size:end])
            if token is None:
                continue
            if size < end:
                before = last[end - size]
                if before == -1:
                    before = self._find_last(data, end - size, last)
                apart = pairs.get((before, token))
                if not (self._neighbours(before, token) if apart is None else apart):
                    continue
            last[end] = token
            return token
        raise ValueError("a byte has no token")

    def edited(self, data: bytes, last: list[int], at: int, until: int, new: bytes,
               ) -> tuple[bytes, list[int], int]:
        """Replace data[at:until]: the new bytes, their list, and how many of its entries were computed.

        Entries before the edit stay. Behind it, once as many entries in a row as the longest token has
        bytes agree with the old ones, all later ones agree as well and are copied.
        """
        changed = data[:at] + new + data[until:]
        shift = len(changed) - len(data)
        fresh = last[:at + 1]
        done, same = at, 0
        while done < len(changed):
            step = min(done + len(new) + 2 * self.longest, len(changed))
            fresh = self.prefixes(changed[:step], fresh)
            for end in range(done + 1, step + 1):
                same = same + 1 if end > at + len(new) and last[end - shift] == fresh[end] else 0
            done = step
            if same >= self.longest:
                fresh.extend(last[step - shift + 1:])
                break
        return changed, fresh, done - at

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a list of last tokens describes."""
        found, end = [], len(last) - 1
        while end > 0:
            found.append(last[end])
            end -= len(self.bytes_of[last[end]])
        found.reverse()
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is itself in the table is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:  # from the front, so that no chain of calls grows with the piece
            return self.tokens(self.prefixes(piece))
        last = [-1] * (len(piece) + 1)
        if piece:
            self._find_last(piece, len(piece), last)
        return self.tokens(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceCache(dict):
    """Piece of text to its ids as little-endian bytes, computed when first asked for.

    A piece is kept in a waiting room first and stays for good once it is asked for again, so that
    words seen once do not displace frequent ones. Both are emptied when they hold `most` entries, so
    memory is bounded; long pieces are not kept.
    """

    def __init__(self, encode, most: int, longest: int = 40):
        super().__init__()
        self.encode, self.most, self.longest, self.waiting = encode, most, longest, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.waiting.pop(piece, None)
        if ids is not None:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
            return ids
        ids = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self.waiting) >= self.most:
                self.waiting.clear()
            self.waiting[piece] = ids
        return ids


class TextEncoder:
    """Whole texts to ids as little-endian bytes, and back.

    A white-space run never follows the other characters of a match, so a text may be cut before each
    space that stands behind another character and the pieces of " word" be remembered by word. Texts
    with a space behind white space go through the pattern as a whole.
    """

    def __init__(self, bpe: PrefixBpe, pattern: str, most: int = 200_000):
        import regex

        self.bpe = bpe
        find = regex.compile(pattern).findall
        piece_ids = PieceCache(self._piece, most)
        self.whole = lambda text: b"".join(map(piece_ids.__getitem__, find(text)))
        self.words = PieceCache(lambda word: self.whole(" " + word), most)
        self.space_run = re.compile(r"\s |^ ").search
        self.token_bytes = [bpe.bytes_of.get(i, b"") for i in range(max(bpe.bytes_of, default=-1) + 1)]

    def _piece(self, piece: str) -> bytes:
        return array_bytes(self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> bytes:
        if self.space_run(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def array_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def text_encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process; tasks that follow each other use its tables again."""
    return TextEncoder(PrefixBpe(read_ranks(ranks_path)), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
                     text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Each match of `pattern` is encoded separately by the ranks in `ranks_path`, a small vocabulary file
    that every machine has. Columns: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes), and ids (array of int) if asked for. A null
    text counts as empty and has no tokens. One row per row, repeated rows included; an empty table gives
    an empty one; other columns are ignored.
    """
    slim = docs.select(F.col(id_column).alias("__id"), F.coalesce(text, F.lit("")).alias("__text"))
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = (f"`{id_column}` {slim.schema['__id'].dataType.simpleString()}, n_tokens bigint, "
              "ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def make():
        encoder = text_encoder(ranks_path, pattern)

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            encoded = list(map(encoder.encode, texts))
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in encoded], pa.string())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in encoded],
                                        pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

        return work

    return arrow_pass(slim, schema, make, rows=1000)


def decode_documents(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids: str = "ids",
                     ) -> DataFrame:
    """Texts of encoded documents: the id and text; bytes that are no UTF-8 become U+FFFD, null ids null."""
    slim = encoded.select(F.col(id_column).alias("__id"), F.col(ids).alias("__ids"))

    def make():
        bpe = PrefixBpe(read_ranks(ranks_path))

        def work(batch: pa.RecordBatch):
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace")
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             [id_column, "text"])
        return work

    return arrow_pass(slim, f"`{id_column}` {slim.schema['__id'].dataType.simpleString()}, text string",
                      make)
