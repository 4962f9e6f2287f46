"""SentencePiece encoding of merge-type models by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tradewell.llm.common import map_texts

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Entries of a task's caches; a full cache starts anew, so memory does not grow with the corpus.
CACHE = 300_000


class PieceCodec:
    """Encodes exactly as the merges would, without running them over the text.

    A sequence of pieces is the merges' result if each piece is the result of its own text and
    each two neighbours are the result of their joint text. Encoding therefore takes the longest
    piece at each position (from one Aho-Corasick pass), goes to a shorter one where the
    neighbours don't agree, and steps back where none is left; a bitfield keeps the positions
    from which no way leads on, so each is left at most once.

    No piece has a space mark after another character, so merges never cross the start of a
    word, and a word's result is kept for its next occurrence. Characters without a piece become
    bytes. The model must be one of merges with byte pieces and without rules that change the
    text; the constructor checks both.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in ids]
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_ids = [i for i, _ in sorted(self.byte.items(), key=lambda x: x[1])]
        self.unknown = {i for i in ids if model.is_unknown(i)}
        self.silent = {i for i in ids if model.is_control(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if len(self.byte_ids) != 256 or model.normalize("ﬁ  ①\t") != "▁ﬁ▁▁①\t":
            raise ValueError("the model needs byte pieces and must leave texts as they are")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.shown = [
            "" if i in self.silent else " ⁇ " if i in self.unknown else p.replace(SPACE, " ")
            for i, p in enumerate(self.pieces)
        ]
        self.decimal = [str(i) for i in ids]
        self._fits: dict[int, bool] = {}
        self._words: dict[str, tuple[tuple[int, ...], str]] = {}
        # Pieces that are not the result of their own text can't occur and are left out.
        whole = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        self.length = [len(p) for p in self.pieces]
        self.shorter = [-1] * len(self.pieces)
        self.matcher = ahocorasick.Automaton()
        for p, i in whole.items():
            self.matcher.add_word(p, i)
            cut = next((n for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in whole), 0)
            self.shorter[i] = self.symbol(p[:cut]) if cut else -1
        self.matcher.make_automaton()

    def symbol(self, piece: str) -> int:
        """The id of a piece, or a number above all ids for a character without one."""
        i = self.ids.get(piece)
        return len(self.pieces) + ord(piece) if i is None else i

    def text_of(self, symbol: int) -> str:
        n = len(self.pieces)
        return self.pieces[symbol] if symbol < n else chr(symbol - n)

    def merged(self, text: str) -> list[str]:
        """The merges themselves, best score first, then leftmost; for a pair of pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the joint text give just these two; the answer is kept."""
        a, b = self.text_of(left), self.text_of(right)
        if len(self._fits) >= 8 * CACHE:
            self._fits.clear()
        known = self._fits[left << 21 | right] = self.merged(a + b) == [a, b]
        return known

    def split(self, word: str) -> list[int]:
        """Symbols of a text within which merges may go."""
        n, above = len(word), len(self.pieces)
        length, shorter, fits, known = self.length, self.shorter, self.fits, self._fits.get
        longest = [-1] * (n + 1)
        for end, i in self.matcher.iter(word):  # of matches with one start, the longest is last
            longest[end + 1 - length[i]] = i
        failed = bytearray(n + 1)
        found: list[int] = []
        at, last, now = 0, -1, longest[0]
        while at < n:
            if now < 0:
                now = above + ord(word[at])
            end = at + (length[now] if now < above else 1)
            if not failed[end]:
                if last < 0 or ((ok := known(last << 21 | now)) is None and fits(last, now)) or ok:
                    found.append(now)
                    at, last, now = end, now, longest[end]
                    continue
            if now < above and shorter[now] >= 0:
                now = shorter[now]
                continue
            failed[at] = 1  # no way on from here
            now = found.pop()
            at -= length[now] if now < above else 1
            last = found[-1] if found else -1
            # the position after ``now`` has failed, so a shorter symbol is next
        return found

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of a word and the same as text."""
        above, ids = len(self.pieces), self.split(word)
        if ids and max(ids) >= above:
            of = lambda i: [i] if i < above else [self.byte_ids[b] for b in chr(i - above).encode()]
            ids = [k for i in ids for k in of(i)]
        made = tuple(ids), ",".join([self.decimal[i] for i in ids])
        if len(word) <= 64:  # long ones hardly come again
            if len(self._words) >= CACHE:
                self._words.clear()
            self._words[word] = made
        return made

    _word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        known, word = self._words.get, self.word
        return [known(w) or word(w) for w in self._word.findall(marked)]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.words(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: bytes that are no UTF-8 become U+FFFD one by one, ids of control
        pieces nothing, and the space put before the first word goes."""
        ids, byte = list(ids), self.byte
        first = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        if byte.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if i in byte:
                    run.append(byte[i])
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(self.shown[i])
            text = "".join(out) + _utf8(bytes(run))
        if first < len(ids) and ids[first] not in byte and ids[first] not in self.unknown:
            text = text.removeprefix(" ")
        return text


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One for each Python worker."""
    return PieceCodec(path)


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, ids: bool = True
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_tokens``, ``ids`` (unless left out),
    ``ids_sha256`` and ``decoded_sha256``.

    Null and empty texts have no ids and decode to an empty text. Each row stands alone, so
    repeated rows and null ids are kept as they are; an empty table gives no rows. Texts are
    whole, however long. ``model`` is a file name of the public tokenizers or a path.
    """
    schema = "n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"

    def work():
        c = codec(model if "/" in model else model_path(model))

        def of(texts: list[str]) -> list[list]:
            rows = []
            for text in texts:
                words = c.words(text)
                found = [i for x, _ in words for i in x]
                joined = ",".join([s for _, s in words])
                rows.append((len(found), *[found] * ids, _sha256(joined), _sha256(c.decode(found))))
            return [list(column) for column in zip(*rows, strict=True)] if rows else [[]] * (3 + ids)

        return of

    return map_texts(docs, id_col, text_col, work, schema)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
