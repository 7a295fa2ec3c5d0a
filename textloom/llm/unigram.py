"""A SentencePiece vocabulary as a unigram model: exact best segmentation, streaming.

The pieces and scores are those of the model file, whatever algorithm it was trained for;
the segmentation is the one with the highest sum of scores, as the library finds it for a
unigram model. Sums are exact (the library adds in float32 from the start of a text, so that
in texts whose sums pass 2**24 its own rounding decides). Ties go as in the library: of equal
sums at one boundary the one whose last piece is longest stays, a single unknown character
comes last. An unknown character becomes its UTF-8 bytes where the model has byte pieces,
else a run of them is one unknown id. White space is escaped, a blank is put before the
text; a model with other normalisation than the identity or with user-defined symbols is
refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
UNK_PENALTY = 10.0
#: Characters after which a stream looks for a boundary that all survivors share, and again.
LOOK = 256


class Unigram:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        made = proto.ModelProto.FromString(model.serialized_model_proto())
        rules = made.normalizer_spec
        if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or made.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only models without normalisation, with escaped blanks and one before the text")
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in made.pieces):
            raise ValueError(f"{path}: user-defined symbols")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unk_id = model.unk_id()
        self.byte_ids: dict[int, int] = {}
        self.surface = [b""] * n
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        joined: set[str] = set()
        scores = []
        self.max_len = 1
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                byte = int(piece[3:5], 16)
                self.byte_ids[byte] = i
                self.surface[i] = bytes([byte])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                score = float(model.get_score(i))
                scores.append(score)
                self.automaton.add_word(piece, (len(piece), i, score))
                self.surface[i] = piece.replace(SPACE, " ").encode()
                self.max_len = max(self.max_len, len(piece))
                if len(piece) == 1:
                    self.singles.add(piece)
                else:
                    joined.update(piece)
        self.automaton.make_automaton()
        self.unk = min(scores) - UNK_PENALTY
        self.bytes_for_unknown = len(self.byte_ids) == 256
        # before a blank that follows another character all paths meet, if blanks only begin pieces; around a line feed, if no piece joins it
        feed = "" if "\n" in joined else "\\n"
        self.feeds = bool(feed)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{feed}]*|[^{SPACE}{feed}]+" + ("|\\n" if feed else "")) if not any(SPACE in p.lstrip(SPACE) for p in self.pieces) else None

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut where every path has a boundary."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.parts.findall(text) if self.parts else [text]

    def chunk_lists(self, texts: pa.Array) -> pa.ListArray:
        """Chunks of each text, as `chunks` gives them, some of them empty."""
        cut = next((c for c in "\x00\x01\x02\x03" if not pc.any(pc.match_substring(texts, c)).as_py()), None) if self.parts else None
        if cut is None:
            return pa.array([self.chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        texts = pc.replace_substring(texts, SPACE, " ")
        wide = pc.match_substring(texts, "  ")
        marked = pc.replace_substring(texts, " ", f"{cut} ")
        if pc.any(wide).as_py():
            marked = pc.replace_with_mask(marked, wide, pc.replace_substring_regex(texts.filter(wide), " +", f"{cut}\\0"))
        if self.feeds:
            marked = pc.replace_substring(marked, "\n", f"{cut}\n{cut}")
        return pc.split_pattern(pc.replace_substring(marked, " ", SPACE), cut)

    def _unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.bytes_for_unknown else [self.unk_id]

    def stream(self, text: str) -> Iterator[list[int]]:
        """ids of a normalised text, in parts: whenever the backpointers of all positions from which a piece may still begin lead through one boundary, what is before it goes out."""
        best, back, last = [0.0], [0], [-1]
        base, look = 0, LOOK
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, len(text) + 1):
            top = None
            start = piece = 0
            while match is not None and match[0] < end:
                length, i, score = match[1]
                sum_ = best[end - length - base] + score
                if top is None or sum_ > top:
                    top, start, piece = sum_, end - length, i
                match = next(matches, None)
            if text[end - 1] not in self.singles:
                sum_ = best[end - 1 - base] + self.unk
                if top is None or sum_ > top:
                    top, start, piece = sum_, end - 1, self.unk_id
            best.append(top)
            back.append(start)
            last.append(piece)
            if end >= look:
                alive = set(range(max(base, end - self.max_len + 1), end + 1))
                while len(alive) > 1:
                    newest = max(alive)
                    alive.discard(newest)
                    alive.add(back[newest - base])
                (meet,) = alive
                if meet > base:
                    yield self._path(text, back, last, base, meet)
                    drop = meet - base
                    zero = best[drop]
                    best, back, last, base = [x - zero for x in best[drop:]], back[drop:], last[drop:], meet
                look = end + max(LOOK, end - base)  # further on the longer none is found, so that all looks together take linear time
        yield self._path(text, back, last, base, len(text))

    def _path(self, text: str, back: list[int], last: list[int], base: int, end: int) -> list[int]:
        ids: list[list[int]] = []
        while end > base:
            piece = last[end - base]
            ids.append(self._unknown(text[end - 1]) if piece == self.unk_id else [piece])
            end = back[end - base]
        return [i for part in reversed(ids) for i in part]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = [i for part in self.stream(chunk) for i in part]
        if not self.bytes_for_unknown:
            ids = [i for k, i in enumerate(ids) if i != self.unk_id or not k or ids[k - 1] != self.unk_id]
        return ids

    def count_chunk(self, chunk: str) -> tuple[int, float]:
        """(ids, score) of a normalised text without finding the ids: each position carries its best sum and the number of ids on the way."""
        best, count, unknown = [0.0], [0], [False]
        base = 0
        matches = self.automaton.iter(chunk)
        match = next(matches, None)
        for end in range(1, len(chunk) + 1):
            top, n, unk = None, 0, False
            while match is not None and match[0] < end:
                length, _, score = match[1]
                at = end - length - base
                sum_ = best[at] + score
                if top is None or sum_ > top:
                    top, n = sum_, count[at] + 1
                match = next(matches, None)
            char = chunk[end - 1]
            if char not in self.singles:
                sum_ = best[-1] + self.unk
                if top is None or sum_ > top:
                    more = len(char.encode()) if self.bytes_for_unknown else int(not unknown[-1])
                    top, n, unk = sum_, count[-1] + more, True
            best.append(top)
            count.append(n)
            unknown.append(unk)
            if len(best) > 4096:
                drop = len(best) - self.max_len
                del best[:drop], count[:drop], unknown[:drop]
                base += drop
        return count[-1], best[-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank put before it; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """The model of a file, loaded once in each process."""
    return _MODELS.get(path) or _MODELS.setdefault(path, Unigram(path))
