"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A sequence of tokens is what a merge list makes of a text if and only if
each pair of neighbours is kept apart by the merge list. So every prefix of a word has
one last token, found from the last tokens of shorter prefixes, and reading a symbol
adds one link to a chain of tokens. A token is emitted once it is stable, which two
rules tell. Any continuation has a border between tokens among the last ``longest``
prefixes, and up to there it consists of the chain of that prefix, as the beginning of
a sequence of tokens is what the merge list makes of the text it covers; so where those
chains meet, all before is stable. And no text further than the sufficient lookahead,
worked out from the merge list, can change a token: whatever ends before that is stable
even if chains have not met. So an open word holds a bounded number of symbols.

Texts are read in pieces and cut inside words of any script, where neither the
normaliser nor the splitter looks across; the open word goes on in the next piece.

Decoding. Tokens go one by one through a state machine that joins their surface forms,
or maps them to bytes and completes UTF-8 sequences that are split over tokens.

Cases: a null or empty text has no tokens. Strings of special tokens in a text are
those tokens, as the tokenizers library reads them. Very long texts are read in pieces;
only a run of combining marks or of unassigned code points is held whole, as the
normaliser orders and joins marks over the whole run. Ties do not arise. Repeated rows
give equal results; an empty table an empty one; columns other than id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
NEVER = 1 << 60
#: Texts are read in pieces of about this many characters.
PIECE = 1 << 16
#: A cache of words has at most twice so many entries.
CACHED_WORDS = 300_000
#: Below this character all Unicode tables at hand agree.
NEW_FROM = "\u0500"


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


def _runs(codes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    first = before = None
    for c in codes:
        if before is None or c != before + 1:
            if first is not None:
                yield first, before
            first = c
        before = c
    if first is not None:
        yield first, before


class MergeTable:
    """A vocabulary with its merges, and what the transducer asks of them."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.surface = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.rank = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, t = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair[x, y] = r
            if t not in self.parts:
                self.rank[t], self.parts[t] = r, (x, y)
        self.longest = max(len(s.removesuffix(END)) for s in self.ids)
        self._apart: dict[tuple[int, int], bool] = {}
        self._made: dict[int, bool] = {}
        special = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = next((x["pattern"]["Regex"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if "pattern" in x), None)
        self.word = regex.compile(split or r"\S+")
        self.raw = raw
        self.joins_bytes = spec.get("decoder") is not None
        self._newer: tuple | None = None

    def decoder(self) -> SurfaceDecoder | ByteDecoder:
        """A new state machine for the file's own decoder: surface forms if it names none, else bytes."""
        return ByteDecoder(self.surface) if self.joins_bytes else SurfaceDecoder(self.surface)

    def newer(self) -> tuple:
        """(pattern of letters and numbers that the library doesn't know, its normaliser)."""
        if self._newer is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(self.raw.decode())
            split = library.pre_tokenizer.pre_tokenize_str
            known = regex.compile(r"[\p{L}\p{N}]")
            marks = [
                c
                for c in range(ord(NEW_FROM), 0x110000)
                if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))
                and len(split(x := f"a{chr(c)}b{chr(c) * 2}")) != len(self.word.findall(x))
            ]
            ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs(marks))
            self._newer = regex.compile(f"[{ranges}]") if ranges else None, library.normalizer.normalize_str
        return self._newer

    def words(self, text: str) -> list[tuple[int, str]]:
        """(place, word) of the words of a text as it came.

        The library takes characters assigned after its own tables for neither letters nor numbers.
        """
        if all(unicodedata.category(c) != "Cn" for c in set(text)):
            return [(m.start(), m[0]) for m in self.word.finditer(normal(text))]
        newer = self.newer()
        plain = newer[1](text)
        if newer[0] is None:
            return [(m.start(), m[0]) for m in self.word.finditer(plain)]
        return [(m.start(), plain[m.start() : m.end()]) for m in self.word.finditer(newer[0].sub("\ue000", plain))]

    def apart(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b`` alone.

        Undo the later of their merges until both are symbols; at each step no merge over the
        border may come before the one undone (at equal rank the left one comes first).
        """
        if limit == NEVER and (known := self._apart.get((a, b))) is not None:
            return known
        key, whole, rank = (a, b), limit == NEVER, self.rank
        while True:
            r = self.pair.get((a, b))
            if r is not None and r < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit = rank[a]
                a = self.parts[a][1]
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = self.parts[b][0]
            else:
                good = True
                break
        if whole:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = good
        return good

    def made(self, t: int) -> bool:
        """Whether merging the symbols of token ``t`` gives that token."""
        if (known := self._made.get(t)) is None:
            known = self.rank[t] < 0 or (
                all(map(self.made, self.parts[t])) and self.apart(*self.parts[t], limit=self.rank[t])
            )
            self._made[t] = known
        return known

    @cached_property
    def lookahead(self) -> int:
        return self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """A number of symbols after which no more text can change a token, from the merge list alone.

        What happens at a border first differs between two continuations by some merge (c, d) over it,
        and only because token d came about or not: the border at d's right, or at the right of a
        token that d's leftmost parts go back to, differed by an earlier merge (a, b) with a the part
        that begins there. So differences run left along merges of growing rank, from (a, b) to (c, d)
        with a on the left edge of d, and cross one token a on each step. The longest such run, in
        symbols, bounds the reach of later text.
        """
        length = {t: len(s.removesuffix(END)) for s, t in self.ids.items()}
        reach: dict[int, int] = {}  # longest run so far that starts at the right border of a token
        most = 0
        for (c, d), _ in sorted(self.pair.items(), key=lambda x: x[1]):
            run, part = length[d], d
            while True:
                if part in reach:
                    run = max(run, length[part] + reach[part])
                if part not in self.parts:
                    break
                part = self.parts[part][0]
            reach[c] = max(reach.get(c, 0), run)
            most = max(most, run)
        return most + self.longest


class WordTransducer:
    """Reads the symbols of one word from left to right and gives out tokens that are stable."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.text = ""  # symbols from the last emitted token on; the first ``base`` ones belong to nothing open
        self.last: list[int] = [-1]  # last token of each prefix
        self.prev: list[int] = [-1]  # where that token begins
        self.context = -1  # the last token emitted
        self.most = 0  # the longest text held

    def _step(self, suffix: str) -> None:
        t, i, text = self.table, len(self.last), self.text
        ids, last, rank_pair = t.ids, self.last, t.apart
        for j in range(max(0, i - t.longest), i):
            token = ids.get(text[j:i] + suffix)
            if token is None or (last[j] == -1 and j):
                continue
            before = last[j] if j else self.context
            if (before < 0 or rank_pair(before, token)) and t.made(token):
                last.append(token)
                self.prev.append(j)
                return
        raise ValueError("a symbol is not in the vocabulary")

    def _emit(self, upto: int) -> list[int]:
        out, i = [], upto
        while i > 0:
            out.append(self.last[i])
            i = self.prev[i]
        if out:
            self.context = out[0]
            self.text = self.text[upto:]
            self.last = [-1, *self.last[upto + 1 :]]
            self.prev = [-1, *(x - upto for x in self.prev[upto + 1 :])]
        return out[::-1]

    def feed(self, symbols: str) -> list[int]:
        """Read symbols of which none is the word's last; returns the tokens that became stable."""
        out: list[int] = []
        for at in range(0, len(symbols), 4 * self.table.longest):
            self.text += symbols[at : at + 4 * self.table.longest]
            while len(self.last) <= len(self.text):
                self._step("")
            self.most = max(self.most, len(self.text))
            out += self._emit(self.meeting())
            if len(self.text) > 2 * self.table.lookahead:
                out += self._emit(self.settled())
        return out

    def settled(self) -> int:
        """The end of the last token that lies the sufficient lookahead before the last symbol read."""
        at = len(self.text)
        while at > len(self.text) - self.table.lookahead:
            at = self.prev[at]
        return max(at, 0)

    def meeting(self) -> int:
        """The place through which the chains of the last ``longest`` prefixes all pass."""
        n = len(self.text)
        at = set(range(max(0, n - self.table.longest + 1), n + 1))
        while len(at) > 1:
            i = max(at)
            at.remove(i)
            at.add(self.prev[i])
        return at.pop()

    def finish(self, symbols: str) -> list[int]:
        """Read the word's remaining symbols, at least one; returns the remaining tokens."""
        out = self.feed(symbols[:-1]) if len(symbols) > 8 * self.table.longest else []
        if not out and len(symbols) <= 8 * self.table.longest:
            self.text += symbols[:-1]
            while len(self.last) <= len(self.text):
                self._step("")
        self.text += symbols[-1]
        self._step(END)
        return out + self._emit(len(self.text))


_SYMBOLS = byte_symbols()
_AS_LATIN = {b: s for b, s in enumerate(_SYMBOLS) if chr(b) != s}


def symbols_of(word: str) -> str:
    """The byte symbols of a word."""
    if word.isascii() and word.isprintable():
        return word
    return word.encode().decode("latin-1").translate(_AS_LATIN)


class WordCache(dict):
    """Token ids of words as little-endian bytes; two generations keep it small."""

    def __init__(self, table: MergeTable, most: int = CACHED_WORDS):
        self.table, self.most, self.older = table, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = np.array(WordTransducer(self.table).finish(symbols_of(word)), "<u4").tobytes()
        if len(word) <= 40:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def normal(text: str) -> str:
    """NFC, white space aside (words never hold it), and each character in lower case by itself."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def _kind(c: str) -> str:
    """Class of a character as to cuts: L letter, N number, S white space, O other; "" where a cut before it is not safe."""
    k = unicodedata.category(c)
    if c.isspace() and not "\x1c" <= c <= "\x1f":  # separators that are white space to Python alone
        return "S"
    if k[0] == "M" or k == "Cn" or "\u1160" <= c <= "\u11ff":  # marks and medial or final Hangul letters join what stands before them
        return ""
    return k[0] if k[0] in "LN" else "O"


def safe_cut(text: str, within: int = 4096) -> tuple[int, str]:
    """(the last place to cut a text, the class of the word that goes on after it or ""); -1 if there is none.

    Both sides, normalised and split apart from each other, give what the whole gives. Contractions
    span an apostrophe and up to two letters, so no cut lies in their reach.
    """
    for i in range(len(text) - 2, max(3, len(text) - within), -1):
        before, after = "O" if text[i - 1] == "İ" else _kind(text[i - 1]), _kind(text[i])  # its lower case ends with a mark
        if not before or not after:
            continue
        if text[i] == "'" or "'" in text[i - 3 : i]:
            if text[i - 1 : i + 2] == "'''":
                return i, "O"
            continue
        return i, before if before == after and before in "LO" else ""
    return -1, ""


class StreamEncoder:
    """Encodes a text that comes in pieces; holds a piece, less than another one and an open word."""

    def __init__(self, cache: WordCache):
        self.cache, self.table = cache, cache.table
        self.tail = ""
        self.open: WordTransducer | None = None
        self.kind = ""  # class of the open word
        self.owed = ""  # the open word's last characters, not read yet

    def feed(self, piece: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of the words known to be whole, and tokens of an open one that are stable."""
        new = max(1, len(self.tail) - 1)
        held = self.tail + piece
        cut, kind = max(held.rfind(" ", new), held.rfind("\n", new)), ""
        if cut < 0:
            if len(held) < PIECE:
                self.tail = held
                return b""
            cut, kind = safe_cut(held)
            if cut < 0:
                self.tail = held
                return b""
        self.tail = held[cut:]
        return self._words(held[:cut], kind)

    def finish(self) -> bytes:
        """The ids of all that is left."""
        held, self.tail = self.tail, ""
        return self._words(held, "")

    def _words(self, text: str, open_end: str) -> bytes:
        """Ids of a text whose last word goes on if ``open_end`` tells a class."""
        if self.open is None and not open_end:
            if text.isascii() or (text and max(text) < NEW_FROM):
                return b"".join(map(self.cache.__getitem__, self.table.word.findall(normal(text))))
            return b"".join(self.cache[w] for _, w in self.table.words(text))
        found = self.table.words(text)
        out = []
        if self.open is not None:
            if found and found[0][0] == 0 and self._goes_on(found[0][1][0]):
                self.owed += found.pop(0)[1]
            if found or not open_end:
                out.append(np.array(self.open.finish(symbols_of(self.owed)), "<u4").tobytes())
                self.open, self.owed = None, ""
        last = found.pop()[1] if open_end and found else ""
        out += [self.cache[w] for _, w in found]
        if last:
            self.open, self.owed, self.kind = WordTransducer(self.table), last, open_end
        if self.open is not None and len(self.owed) > 8:
            ready, self.owed = self.owed[:-8], self.owed[-8:]
            out.append(np.array(self.open.feed(symbols_of(ready)), "<u4").tobytes())
        return b"".join(out)

    def _goes_on(self, first: str) -> bool:
        return regex.match(r"\p{L}" if self.kind == "L" else r"[^\s\p{L}\p{N}]", first) is not None


def encode_pieces(text: str, cache: WordCache) -> Iterator[bytes]:
    """Ids of a text, piece by piece."""
    special = cache.table.special_at
    at = 0
    for m in [*special.finditer(text), None] if special and any(x in text for x in cache.table.special) else [None]:
        upto = m.start() if m else len(text)
        encoder = StreamEncoder(cache)
        for i in range(at, upto, PIECE):
            yield encoder.feed(text[i : min(upto, i + PIECE)])
        yield encoder.finish()
        if m:
            yield np.array([cache.table.special[m[0]]], "<u4").tobytes()
            at = m.end()


class SurfaceDecoder:
    """Joins the surface forms of tokens by spaces, as a tokenizer without a decoder does."""

    def __init__(self, surface: dict[int, str]):
        self.surface, self.begun = surface, False

    def push(self, ids: Iterable[int]) -> str:
        out = " ".join(map(self.surface.__getitem__, ids))
        if not out:
            return out
        out = f" {out}" if self.begun else out
        self.begun = True
        return out

    def finish(self) -> str:
        return ""


class ByteDecoder:
    """Byte symbols to text: word ends become spaces and UTF-8 sequences may span tokens."""

    def __init__(self, surface: dict[int, str]):
        self.surface = surface
        self.byte = {s: bytes([b]) for b, s in enumerate(_SYMBOLS)}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            s = self.surface[i]
            word = s.removesuffix(END)
            out.append(self.utf8.decode(b"".join(self.byte.get(c, c.encode()) for c in word)))
            if word != s:
                out.append(" ")
        return "".join(out)

    def finish(self) -> str:
        """What an unfinished sequence at the end gives."""
        return self.utf8.decode(b"", True)


_tables: dict[str, WordCache] = {}


def word_cache(raw: bytes) -> WordCache:
    """The cache of a vocabulary file's content, one in each process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _tables:
        _tables[key] = WordCache(MergeTable(raw))
    return _tables[key]


def encode_row(text: str | None, cache: WordCache, keep_ids: bool) -> tuple[int, str, str, bytes]:
    """(number of tokens, digest of ids, digest of the decoded text, ids) of one text."""
    ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
    decoder, n, kept = cache.table.decoder(), 0, []
    for ids in encode_pieces(text or "", cache):
        n += len(ids) // 4
        ids_hash.update(ids)
        text_hash.update(decoder.push(np.frombuffer(ids, "<u4").tolist()).encode())
        if keep_ids:
            kept.append(ids)
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest(), b"".join(kept)


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) for every row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content, fixed in size, is broadcast.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(raw.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [encode_row(x.as_py(), cache, with_ids) for x in batch.column("text")]
                n, a, b, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
                out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(np.array(n, np.int64))]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(out)])

    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)


def decode_documents(tokens: DataFrame, vocabulary: str, as_bytes: bool | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) for every row of ``tokens``, from its list of token ids; null ids give a null text.

    ``as_bytes`` chooses the byte decoder or the joining of surface forms; None leaves it to the file.
    """
    with open(vocabulary, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    picked = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_cache(raw.value).table
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder = table.decoder() if as_bytes is None else ByteDecoder(table.surface) if as_bytes else SurfaceDecoder(table.surface)
                texts.append(None if ids is None else decoder.push(ids) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return picked.mapInArrow(run, f"doc_id {kind}, text string")


def op2_bpe(docs: DataFrame) -> DataFrame:
    """The digest of ``encode_documents`` over documents with the public word vocabulary."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
