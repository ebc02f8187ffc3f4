"""Secret scans by dictionary-primed zstandard novelty.

Base finds are assignments of secrets, access keys and hex runs. To these the method
adds strings near words of a sensitive context that are novel: zstandard, primed with a
dictionary of identifiers, compresses a frame of the surrounding text and reference
names without and with the candidate, and the difference in bytes, against that of random
strings of its length, is its novelty. The frame is long enough for entropy coding to act
on the candidate's letters, so words and identifiers of any make shrink and random
strings of any alphabet do not. Novelty alone decides; a candidate is any run of 14 or more letters, digits
and signs of such strings, up to 80 characters after a context word or 40 before one. UUIDs
and times are as novel as keys and mostly none: they count only right after a context word.

Cases: a null or empty text has no spans. Overlapping finds of several kinds are all
kept; equal starts go by kind. Very long texts are scanned whole in linear time and a
long candidate is followed to its end and measured in pieces. Repeated rows give equal
results; an empty table an empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._words import give_back, slices

KINDS = ("assign", "access", "hex", "novel")
#: Patterns of the base finds and the least length of what they hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words after which a string may be a secret.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|authorization|bearer|signature"
    r"|(?:api|access|private|account|auth|signing|encryption)[_ -]?key|client[_-]secret|conn(?:ection)?[_-]?string)(?![A-Za-z])",
    re.IGNORECASE | re.ASCII,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
#: Formats of ids and times, and what may stand between a context word and one that it names.
NOTED = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|(?:19|20)\d\d[-/_]?[01]\d[-/_]?[0-3]\d[T/_-]?[0-2]\d[-/_]?[0-5]\d(?:[-/_]?[0-5]\d(?:[-/_]?\d{3,9})?)?Z?"
)
NAMES_IT = re.compile(r"[\s\"'(<]{0,3}(?:(?:is|[:=]|=>)[\s\"'(<]{0,3})?")
#: Characters after a context word, and before one, in which a candidate may lie.
REACH, BACK = 80, 40
#: A candidate is novel if it adds at least this part of what random strings of its length add; the README has the rates.
LEAST_NOVELTY = 0.85
#: A long candidate is measured in pieces of about this length, so that it can't bring its own code tables.
MEASURED = 32
#: Words and identifiers that configuration and code hold near secrets; they prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer signature "
    "config configuration settings environment variable default example placeholder username user account database "
    "connection string hostname localhost endpoint service region bucket production development staging testing "
    "public static final string return function import from class self none null true false undefined const let var "
    "export require module request response headers content-type application/json get_password set_password "
    "password_hash get_secret_value secret_manager access_token refresh_token token_type expires_in client_id "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 changeme "
    "your_password_here your_api_key_here my_secret_token insert_token_here "
)


#: Public modules whose names and documentation make up the dictionary, and others whose names stand in every frame.
MODULES = (
    "builtins os json collections logging threading subprocess argparse datetime pathlib string re socket ssl urllib.request configparser "
    "hashlib hmac getpass http.client email.message"
)
FRAME_MODULES = "decimal calendar mailbox shutil tempfile optparse smtplib zipfile csv statistics"


def _names(modules: str, documented: bool) -> list[str]:
    out: list[str] = []
    for name in modules.split():
        module = importlib.import_module(name)
        for attribute in dir(module):
            value = getattr(module, attribute)
            out += [attribute, *(dir(value) if isinstance(value, type) else ())]
            out += [str(getattr(value, "__doc__", None) or "")[:2000]] * documented
    return [x for x in out if x]


@cache
def identifier_dictionary(size: int = 32_768, framed: int = 1600) -> tuple[bytes, str]:
    """(content that zstandard's trainer picks from public names and documentation, IDENTIFIERS and about ``framed`` characters of other names)."""
    content = zstandard.train_dictionary(size, [x.encode() for x in _names(MODULES, True)], level=19).as_bytes()
    others = sorted({x for x in _names(FRAME_MODULES, False) if re.fullmatch("[A-Za-z][A-Za-z0-9_]{5,24}", x)})
    every = max(1, sum(len(x) + 1 for x in others) // framed)
    return content, IDENTIFIERS + " ".join(others[::every])


def _copies(s: str) -> list[str]:
    """What counts as a copy of a candidate: itself, and itself without signs that may join it to a name."""
    return sorted({x for x in (s, s.strip("+/_=-")) if len(x) >= 12}, key=lambda x: (-len(x), x))


class Novelty:
    """Bytes that a string adds to a frame of its surroundings, by zstandard with a dictionary of identifiers."""

    def __init__(self, dictionary: tuple[bytes, str] | None = None, around: int = 256, level: int = 19):
        content, self.reference = dictionary or identifier_dictionary()
        primer = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.size = lambda x, squeeze=zstandard.ZstdCompressor(level=level, dict_data=primer, **plain): len(squeeze.compress(x))
        self.around = around
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        draw = random.Random(20240611)
        self.noise = ["".join(draw.choices(letters, k=MEASURED)) for _ in range(4)]

    def of(self, text: str, start: int, end: int) -> float:
        """What ``text[start:end]`` adds to the compressed frame of reference names and the text around it,
        in parts of what random base64 of the same length adds to that frame.

        Copies of the string around it, whole or cut by the edge, are no part of the frame:
        a secret that stands twice is as novel in both places.
        """
        size = end - start
        before, after = text[max(0, start - self.around - size) : start], text[end : end + self.around + size]
        for copy in _copies(text[start:end]):
            before, after = before.replace(copy, " "), after.replace(copy, " ")
        frame = f"{self.reference}{after[: self.around]}\n{before[-self.around :]}".encode()
        alone, pieces = self.size(frame), -(-size // MEASURED)
        added = lambda part: self.size(frame + part.encode()) - alone
        parts = [text[start + i * size // pieces : start + (i + 1) * size // pieces] for i in range(pieces)]
        usual = sum(added(x[: len(parts[-1])]) for x in self.noise) / len(self.noise) / len(parts[-1])
        return sum(map(added, parts)) / size / usual


def novel_spans(text: str, novelty: Novelty, least: float = LEAST_NOVELTY) -> Iterator[tuple[int, int, str]]:
    """Candidates near a context word whose novelty is at least ``least``."""
    contexts = [m.span() for m in CONTEXT.finditer(text)]
    starts, ends = [a for a, _ in contexts], [b for _, b in contexts]
    for m in CANDIDATE.finditer(text) if contexts else ():
        start, end = m.span()
        before, after = bisect_left(ends, start + 1) - 1, bisect_left(starts, end)
        near = (before >= 0 and start - ends[before] <= REACH) or (after < len(starts) and starts[after] - end <= BACK)
        if near and NOTED.fullmatch(m[0]):
            near = before >= 0 and NAMES_IT.fullmatch(text[ends[before] : start]) is not None
        if near and novelty.of(text, start, end) >= least:
            yield start, end, "novel"


def secret_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start and then kind."""
    low = text.lower()
    out: list[tuple[int, int, str]] = []
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if CONTEXT.search(text):
        base = tuple(out)
        out += [x for x in novel_spans(text, novelty) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, found array<struct<kind,start,end>>[, clean_text]) for every row of ``docs``."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    dictionary = identifier_dictionary()  # 36 KB, sent with the function: all executors measure alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            found, clean = [], []
            for x in batch.column("text"):
                text = x.as_py()
                spans = secret_spans(text or "", novelty)
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                if redact:
                    clean.append(redacted(text, spans) if spans else text)
            out = [batch.column("doc_id"), pa.array(found, _SPAN)] + [pa.array(clean, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "found", "clean_text"][: len(out)])

    return picked.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>" + ", clean_text string" * redact)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with the secrets of each text replaced by a mark."""

    dictionary = identifier_dictionary()  # 36 KB, sent with the function: all executors measure alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in slices(batches):
            clean = []
            for x in batch.column("text"):
                text = x.as_py()
                spans = secret_spans(text, novelty) if text else []
                clean.append(redacted(text, spans) if spans else text)
            yield batch.set_column(1, "text", pa.array(clean, pa.string()))
        give_back()

    # The other columns travel in a struct, so their names do not matter.
    at = docs.columns.index(text_col)
    quoted = [f"`{n.replace('`', '``')}`" for n in docs.columns]
    rest = F.struct(F.lit(0).alias("_"), *(F.col(q) for i, q in enumerate(quoted) if i != at)).alias("row")
    packed = docs.select(rest, F.col(quoted[at]).cast("string").alias("text"))
    clean = packed.mapInArrow(run, packed.schema)
    own = F.col("text").cast(docs.schema[at].dataType).alias(text_col)
    return clean.select(*(own if i == at else F.col("row").getField(n).alias(n) for i, n in enumerate(docs.columns)))


def op1_secrets(docs: DataFrame) -> DataFrame:
    """The digest of ``scan_secrets`` over documents."""
    found = scan_secrets(docs)
    kinds = F.transform("found", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *n[:3], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), n[3])


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The base digest of one text's spans, as the query has it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "novel").encode()).hexdigest()
