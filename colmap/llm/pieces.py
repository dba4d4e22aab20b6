"""Sentencepiece ids of texts by exact backtracking, and texts from ids.

A merge-type model joins, again and again, the two neighbours whose union is the piece
of best score, the leftmost first. The result is the only sequence of pieces in which
every two neighbours stay as they are when their joint text is merged anew. So no
queue of merges is needed: from left to right the longest piece that starts at a
position (found for all positions by one Aho-Corasick pass) is taken if it is
compatible with the piece before it; else the next shorter piece that starts there. If
none is, no encoding has a boundary here: the position is marked in a bitfield, the
piece before is taken back and shortened instead. Whether two pieces are compatible is
found by merging their joint text, and remembered.

The text is normalized as the model says: one space in front, spaces shown as U+2581.
Characters that are no piece become the pieces of their UTF-8 bytes. Where no piece
of the model holds a space behind another character, or a letter beside another
character, texts are cut at such places into units that are encoded one by one, each
once per worker as long as it is remembered.

Cases: null is the empty text, which has no ids; a text is encoded whole, whatever its
length; U+2581 in a text counts as a space, as in the library, and so comes back as
one; strings that look like control or byte pieces are ordinary text; repeated rows are
encoded alike; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from colmap.llm.common import Remembered

SPACE = "▁"
ENCODED = "struct<ids array<int>, decoded string>"
#: units, and pairs of pieces, that a worker remembers
UNITS = 700_000
PAIRS = 200_000
#: characters of texts that are handled together
GROUP_CHARS = 1 << 18


#: what comes after the last merge
LAST = (1 << 60, "")


def merges(text: str, rank: dict[str, int]) -> tuple[list[str], list[tuple[int, str]], list]:
    """The pieces left after all merges of ``text``, best rank first and leftmost among
    equals; and of each merge the rank with the last piece, and with the first piece."""
    parts = list(text)
    ends, starts = [], []
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        ends.append((best, parts[-1]))
        starts.append((best, parts[0]))
    return parts, [*ends, LAST], [*starts, LAST]


LETTERS, OTHERS = r"[^\W\d_]+", rf"(?:[^{SPACE}\w]|[\d_])+"


def _units(pieces: Iterable[str]) -> Callable[[str], list[str]]:
    """Cuts a text where no piece reaches across.

    The first of these rules that all pieces keep is taken: spaces stand only in front
    and letters only beside letters; spaces stand only in front; none.
    """
    rest = f"[^{SPACE}]+"
    for kinds in ((LETTERS, OTHERS), (rest,)):
        rule = re.compile("|".join([f"{SPACE}*{kind}" for kind in kinds] + [f"{SPACE}+"]))
        if all(rule.fullmatch(p) for p in pieces):
            return rule.findall
    return lambda text: [text]


class PieceEncoder:
    """Encodes texts with a sentencepiece model of the merge type."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(order)}
        self.search = ahocorasick.Automaton()
        for piece in self.ids:
            self.search.add_word(piece, (len(piece) - 1, piece))
        self.search.make_automaton()
        # the next shorter piece that a piece starts with
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids),
                                p[0] if len(p) > 1 else None) for p in self.ids}
        self.units = _units(self.ids)
        self.steps = Remembered(self._merges, 1 << 20)  # one per piece or character
        self.compatible = Remembered(self._merges_back, PAIRS)
        self.known = Remembered(self._unit_ids, UNITS)

    def _merges(self, piece: str):
        """The merges that make a piece, or none if they make something else."""
        parts, ends, starts = merges(piece, self.rank)
        return (ends, starts) if len(parts) == 1 else ()

    def _merges_back(self, pair: tuple[str, str]) -> bool:
        """Do two pieces come back when their joint text is merged?

        Their own merges are gone through in the order of the joint text; none of the
        unions across the boundary may come first.
        """
        left, right = pair
        if not right or not self.steps[right] or left and not self.steps[left]:
            return False
        if not left:
            return True
        ends, starts = self.steps[left][0], self.steps[right][1]
        rank, i, j, last, first = self.rank.get, 0, 0, left[-1], right[0]
        while True:
            across, (on_left, longer), (on_right, wider) = rank(last + first), ends[i], starts[j]
            # of equal ranks the leftmost comes first
            if across is not None and across < on_left and across <= on_right:
                return False
            if on_left <= on_right:
                if on_left == LAST[0]:
                    return True
                i, last = i + 1, longer
            else:
                j, first = j + 1, wider

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a text without normalization, by backtracking."""
        longest, size = list(unit), len(unit)
        for end, (before_end, piece) in self.search.iter(unit):
            longest[end - before_end] = piece  # longer ones end later
        compatible, shorter = self.compatible, self.shorter
        failed, any_failed = bytearray(size // 8 + 1), False
        taken: list[str] = []
        at, before = 0, ""
        piece = longest[0] if unit else None
        while at < size:
            while piece is not None:
                if compatible[before, piece]:
                    end = at + len(piece)
                    if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                taken.append(piece)
                at, before = end, piece
                if at < size:
                    piece = longest[at]
                continue
            failed[at >> 3] |= 1 << (at & 7)
            any_failed = True
            piece = taken.pop()
            at -= len(piece)
            before = taken[-1] if taken else ""
        return taken

    def _unit_ids(self, unit: str) -> bytes:
        found, pieces = [], self.pieces(unit)
        try:
            found = [self.ids[p] for p in pieces]
        except KeyError:
            for piece in pieces:
                i = self.ids.get(piece)
                if i is not None:
                    found.append(i)
                elif self.bytes:
                    found += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
                else:
                    found.append(self.unknown)
        return array("i", found).tobytes()

    def encode(self, text: str | None) -> array:
        """The ids of a text."""
        if not text:
            return array("i")
        units = self.units(SPACE + text.replace(" ", SPACE))
        return array("i", b"".join(map(self.known.__getitem__, units)))

    def decode(self, ids: array) -> str:
        """The text of ids."""
        return self.model.decode(ids.tolist())


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(text: Column, path: str) -> Column:
    """(ids, decoded) of each text: its ids, and the text that these ids give."""

    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        pieces, parts = encoder(path), []
        lengths, ids, decoded = array("i", [0]), array("i"), []

        def close():
            listed = pa.ListArray.from_arrays(
                pa.array(lengths, pa.int32()), pa.array(memoryview(ids), pa.int32()))
            parts.append(pa.StructArray.from_arrays(
                [listed, pa.array(decoded, pa.string())], ["ids", "decoded"]))

        for at in range(0, len(texts), 64):
            for text in texts.slice(at, 64).to_pylist():
                found = pieces.encode(text)
                ids += found
                lengths.append(len(ids))
                decoded.append(pieces.decode(found))
            if len(ids) >= GROUP_CHARS:
                close()
                lengths, ids, decoded = array("i", [0]), array("i"), []
        if decoded or not parts:
            close()
        return pa.concat_arrays(parts)

    return encode(text)
