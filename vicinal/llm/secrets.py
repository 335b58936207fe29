"""Secret scans: fixed patterns, and novelty under dictionary-primed compression."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import lean

# The patterns, and how long a match must be.
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "novel")

#: Words near which a string that does not compress is taken for a secret.
SENSITIVE = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "auth", "bearer", "credential", "private", "signature", "access_key", "access-key", "client_id", "session", "cookie")
#: A candidate: a run of LONG characters of keys or more, whole, with a digit and a letter in it.
LONG = 16
START = re.compile(r"[A-Za-z0-9+/_=-]{16}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What joins a run to the next: a dot, or a line break (also a spelled one) if the next run has a line of its own.
JOINED = re.compile(r"""(?:\.|["']?[ \t]*[+\\]?[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>#*|]*["']?(?=[A-Za-z0-9+/_=-]+["']?[ \t]*[+,;)\\]?[ \t]*(?:[\r\n]|\\[rn]|\Z)))([A-Za-z0-9+/_=-]+)""")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
PEM_FIELDS = re.compile(r"(?:(?:\s|\\[rn])*[A-Za-z][A-Za-z-]*:[^\n\\]*)*")
#: Text before a candidate in which a sensitive word must stand, text around it that primes the compressor, and text that is scored at once.
NEAR, AROUND, PIECE = 48, 256, 512
#: Up to SHORT characters amid KNOWN words the compressor stores what its dictionary does not hold as it is: a key takes
#: SURE bytes for each character, or more, a name made of known words less.  Hexadecimal digits and longer keys are packed.
SHORT, SURE, HEX_RUN = 64, 0.8, re.compile(r"[0-9a-f]+|[0-9A-F]+")
KNOWN = " request response header headers body content "

#: What identifiers and settings usually consist of: the compressor's dictionary.
DICTIONARY_WORDS = """
import from return class function def static public private protected final const let var void string int long float double boolean
null none true false self this super new delete try catch finally raise throw throws except async await yield lambda with open read write
close file path name value key keys values item items index count size length list dict map set array object type types node tree root
parent child children left right first last next previous start end begin stop step config configuration settings options option default
environment variable variables server client host hostname port url uri http https www example com org net localhost address request
response header headers body content text html json xml yaml csv data database table column row rows query select insert update delete
where order group join limit offset user username password passwd secret token api_key apikey access_key secret_key client_id client_secret
auth authorization authentication bearer credential credentials private public certificate signature session cookie login logout register
account email message error warning info debug log logger logging test tests testing assert expected actual result results output input
argument arguments parameter parameters method methods module package version license description author date time timestamp year month
day hour minute second created updated deleted status state active enabled disabled required optional unknown undefined placeholder
your_password_here your_api_key_here changeme example_token insert_your_token_here xxxxxxxxxxxxxxxx abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890 the and that for are with this have from they which their there
""".split()


def dictionary() -> bytes:
    """Raw content for the compressor: identifiers in the spellings that code uses, the usual ones last."""
    camel = [a + b.capitalize() for a, b in zip(DICTIONARY_WORDS, DICTIONARY_WORDS[1:], strict=False)]
    snake = ["_".join(x) for x in zip(DICTIONARY_WORDS, DICTIONARY_WORDS[1:], strict=False)]
    return " ".join([*camel, *snake, *(w.upper() for w in DICTIONARY_WORDS), *DICTIONARY_WORDS]).encode()


class Novelty:
    """Marginal compressed bytes of a string against what surrounds it and the dictionary."""

    def __init__(self, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def share(self, before: str, candidate: str, after: str) -> float:
        """Marginal bytes for each character of the candidate; nothing known of it: about 1, or 0.6 for hexadecimal digits."""
        return (self.size(before + candidate + after) - self.size(before + after)) / len(candidate)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the fixed patterns."""
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no base span touches."""
    out = []
    for s, _, e in base:
        if a < e and s < b:
            if a < s:
                out.append((a, s))
            a = e
    return [*out, (a, b)] if a < b else out


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that hardly compress, without what base spans touch.

    A candidate is a whole run, however long.  It is scored in pieces of PIECE
    characters at most, and one piece that hardly compresses takes the run.
    The context carries on over runs that are joined: from the first novel run
    of them to the last is one span, and a short rest that looks like a key's
    end belongs to it.  The body of a private key's block is one candidate.
    """
    places = [m.end() for w in SENSITIVE if w in low for m in re.finditer(re.escape(w), low)]
    if not places or len(low) != len(text):  # lower case of a few letters is longer
        places = [m.end() for m in re.finditer("|".join(map(re.escape, SENSITIVE)), text, re.I | re.A)] if places else []
    out: list[tuple[int, int, int]] = []
    ends: dict[int, bool] = {}  # by the end of a run scored before, whether it was taken

    def mixed(word: str) -> bool:
        return any(c.isdigit() for c in word) and any(c.isalpha() for c in word)

    def novel(a: int, b: int, first: bool = False) -> bool:
        n = -(-(b - a) // PIECE)
        cuts = [a + (b - a) * k // n for k in range(n + 1)]
        for s, e in [(a, min(b, a + PIECE))] if first else zip(cuts, cuts[1:], strict=False):
            plain = e - s > SHORT or HEX_RUN.fullmatch(text, s, e) or novelty.share(KNOWN, text[s:e], KNOWN) >= SURE
            if plain and novelty.share(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]) >= least:
                return True
        return False

    def chain(a: int, b: int) -> None:
        """Take the novel runs among those joined from [a, b) on."""
        if b in ends:  # from within a run scored before
            if not ends[b] and mixed(text[a : min(b, a + PIECE)]) and outside(a, b, base) == [(a, b)] and novel(a, b, True):
                ends[b] = True
                out.append((a, 3, b))
            return
        m = RUN.match(text, a)
        begin = end = None  # of the span under way
        while m is not None:
            a, b = m.span(m.lastindex or 0)
            parts = outside(a, b, base)
            touched = parts != [(a, b)]
            if touched and begin is not None:
                out.append((begin, 3, end))
                begin = None
            ends[b] = False
            for s, e in parts:
                word = text[s:e]
                if e - s >= LONG:
                    taken = (begin is not None or mixed(word)) and novel(s, e)
                else:  # the rest of a key that was cut into lines or by dots
                    last = JOINED.match(text, end) if begin is not None and not touched else None
                    taken = last is not None and last.start(1) == s and (mixed(word) or word.endswith("=") or "PRIVATE KEY" in text[max(0, begin - AROUND) : begin])
                if taken:
                    ends[b] = True
                    if touched:
                        out.append((s, 3, e))
                    else:
                        begin, end = s if begin is None else begin, e
            m = JOINED.match(text, b)
        if begin is not None:
            out.append((begin, 3, end))

    blocks = []
    for m in PEM.finditer(text) if places else ():
        a = PEM_FIELDS.match(text, m.end()).end()
        b = text.find("-----", a)
        if b >= 0 and text.startswith("-----END", b):
            body = text[a:b]
            a, b = a + len(body) - len(body.lstrip()), a + len(body.rstrip())
            if b - a >= LONG and novel(a, b):
                out += [(s, 3, e) for s, e in outside(a, b, base)]
                blocks.append((a, 3, b))
                continue
        places.append(a)
    begin = upto = 0  # the last run, whose end is looked for once
    for place in sorted(places):
        at, stop = place, min(len(text), place + NEAR + LONG)
        while at < stop and (m := START.search(text, at, stop)):
            a = m.start()
            if not begin <= a < upto:
                begin, upto = a, RUN.match(text, a).end()
            at = upto
            if not any(s < at and a < e for s, _, e in blocks):
                chain(a, at)
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(text: str | None, novelty: Novelty, least: float = 0.55) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and the spans that novelty adds; null text is empty."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    return base, novel_spans(text, low, base, novelty, least)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.55) -> DataFrame:
    """doc_id, counts of base matches, digest of the base spans, and all spans.

    A candidate near a sensitive word is reported whole if each character of
    it, or of a piece of a long one, adds ``least`` compressed bytes or more to
    its surroundings (and, where it is short and not hexadecimal, 0.8 or
    more amid known words); the parts of a key joined by dots, lines or a block of a
    private key share the word.  Null and
    empty texts have no spans (the digest is that of nothing); repeated rows
    are scanned one by one; other columns are left out.  Rows are independent:
    nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, more = scan(text.as_py(), novelty, least)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc, *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", least: float = 0.55) -> DataFrame:
    """``docs`` with secrets in the text replaced; all rows and columns stay, and a column of lengths follows the text."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at)
            new = []
            for value in old:
                text = value.as_py()
                base, more = scan(text, novelty, least)
                new.append(redact(text, base + more))
            columns[at] = pa.array(new, old.type)
            if count is not None:
                kind = columns[count].type
                columns[count] = pa.array([c if a.as_py() == b else len(b) for a, b, c in zip(old, new, columns[count].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and columns, with a mark in place of each secret; null and empty texts stay as they are."""
    return redact_secrets(docs)
