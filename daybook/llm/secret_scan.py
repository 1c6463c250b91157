"""Find secrets, also below layers of URL, Unicode, base64 and compressed encoding.

A worklist starts with the text itself. Each layer is scanned and then unwrapped: percent and
``\\u`` escapes give a layer of the whole string with the escapes replaced, a base64 run gives
layers of what it decodes to, and gzip, zlib or bz2 data in any of these give a layer of what they
hold, members that follow one another together. Bytes are taken as Latin-1, which is enough for
patterns of ASCII; where they hold NUL, once more without. Runs are joined over line breaks and
decoded from each of their first four characters, as other text may be glued to them.

Every layer knows for each of its characters which span of the original text it stands for, so a
find maps back to the text. A layer that was seen before (the same characters over the same spans)
is not taken again; that ends rings such as archives that hold themselves. Escapes and base64
always shrink, and what inflates shares a budget of ``MAX_INFLATED`` characters a text; a text
that reaches it is marked ``cut_short``, and data it left unread are masked, so nothing is dropped
unseen.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import arrow_strings, map_batches, table

KINDS = ("assign", "access", "hex")
MAX_INFLATED = 64_000_000
MASK = "[secret]"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# A run is taken whole from its first character, so "at least so long" drops the same runs as a
# test of the length afterwards. That does not hold for assignments: see ``scan``.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
_BREAKS = re.compile(_BREAK)
_MAGIC = re.compile(r"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|x[\x01\x5e\x9c\xda]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of one layer: leftmost, not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        # A match whose value is too short still uses up its characters.
        out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A string and, for each character, the span of the text that it stands for."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, Same):
            return self.starts.value, self.ends.value
        return min(self.starts[start:end]), max(self.ends[start:end])


class Same:
    """One number again and again."""

    __slots__ = ("n", "value")

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __getitem__(self, at):
        return [self.value] * len(range(*at.indices(self.n))) if isinstance(at, slice) else self.value


def _plain(raw: bytes) -> str | None:
    """Bytes as text, if they are text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _member(raw: memoryview, budget: list[int]) -> tuple[bytes, int, bool]:
    """(what one gzip, zlib or bz2 stream holds, bytes it takes or 0 if it has no end, whether the budget cut it)."""
    zipped = raw[:1] != b"B"
    unpack = zlib.decompressobj(47) if zipped else bz2.BZ2Decompressor()
    out, at = [], 0
    try:
        while not unpack.eof:
            if budget[0] <= 0:
                return b"".join(out), len(raw), True
            waiting = unpack.unconsumed_tail if zipped else b""
            if waiting or not (zipped or unpack.needs_input):
                piece = unpack.decompress(waiting, budget[0])
            elif at < len(raw):
                piece = unpack.decompress(raw[at : at + 4096], budget[0])
                at += 4096
            else:
                break
            out.append(piece)
            budget[0] -= len(piece)
    except (zlib.error, OSError, ValueError, EOFError):
        return b"".join(out), 0, False
    return b"".join(out), min(at, len(raw)) - len(unpack.unused_data) if unpack.eof else 0, False


def _inflated(layer: Layer, budget: list[int], cut: set) -> Iterator[Layer]:
    """A layer for each chain of compressed streams, wherever it starts."""
    m = _MAGIC.search(layer.text)
    if m is None:
        return
    raw = memoryview(layer.text.encode("latin-1", "replace"))
    while m is not None:
        start = end = m.start()
        held, short = [], False
        while m is not None and m.start() == end and not short:
            found, taken, short = _member(raw[end:], budget)
            held.append(found)
            if not taken:
                break
            end += taken
            m = _MAGIC.search(layer.text, end)
        lo, hi = layer.span(start, max(end, start + 1) if taken else len(layer.text))
        if short:
            cut.add((lo, hi, 0))
        text = b"".join(held).decode("latin-1")
        if text:
            yield from _bytes_layers(text, Same(lo, len(text)), Same(hi, len(text)))
        if not taken:
            m = _MAGIC.search(layer.text, end + 1)


def _bytes_layers(text: str, starts, ends) -> Iterator[Layer]:
    """Bytes as Latin-1 characters, and without NUL if there are any: UTF-16 of ASCII is text then."""
    yield Layer(text, starts, ends)
    if "\0" in text:
        at = [i for i, c in enumerate(text) if c != "\0"]
        yield Layer(text.replace("\0", ""), [starts[i] for i in at], [ends[i] for i in at])


def _unescaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with the matches of ``pattern`` replaced by the characters they encode."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        found = decode(m.group())
        if found is None:
            continue
        changed = True
        parts.append(layer.text[at : m.start()])
        starts.extend(layer.starts[at : m.start()])
        ends.extend(layer.ends[at : m.start()])
        for char, lo, hi in found:
            lo, hi = layer.span(m.start() + lo, m.start() + hi)
            parts.append(char)
            starts.append(lo)
            ends.append(hi)
        at = m.end()
    if not changed:
        return None
    return Layer("".join([*parts, layer.text[at:]]), [*starts, *layer.starts[at:]], [*ends, *layer.ends[at:]])


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _percent_bytes(run: str) -> list[tuple[str, int, int]]:
    return [(chr(int(run[i + 1 : i + 3], 16)), i, i + 3) for i in range(0, len(run), 3)]


def _unicode(run: str) -> list[tuple[str, int, int]] | None:
    if run[2] == "{":
        code = int(run[3:-1], 16)
        return [(chr(code), 0, len(run))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00), 6 * i, 6 * i + 12))
            i += 2
        else:
            out.append((chr(u) if not 0xD800 <= u < 0xE000 else "�", 6 * i, 6 * i + 6))
            i += 1
    return out


def _decoded(run: str, phase: int) -> bytes:
    part = run[phase:]
    part = part[: len(part) - (len(part) % 4 == 1)]
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _unwrapped_runs(layer: Layer) -> Iterator[Layer]:
    """Layers for each base64 run that holds text, compressed data or anything else to look into."""
    for m in _BASE64.finditer(layer.text):
        run = m.group().rstrip("=").translate(_STANDARD)
        text = _plain(_decoded(run, 0))
        if text is not None:  # the whole run stands for it
            lo, hi = layer.span(m.start(), m.end())
            yield Layer(text, Same(lo, len(text)), Same(hi, len(text)))
        yield from _phases(layer, run, range(m.start(), m.start() + len(run)), text is not None)
    for m in _WRAPPED.finditer(layer.text):
        whole = m.group().rstrip("=")
        at = 0
        places: list[int] = []
        for gap in _BREAKS.finditer(whole):
            places.extend(range(m.start() + at, m.start() + gap.start()))
            at = gap.end()
        places.extend(range(m.start() + at, m.start() + len(whole)))
        yield from _phases(layer, _BREAKS.sub("", whole).translate(_STANDARD), places, False)


_STANDARD = str.maketrans("-_", "+/")


def _phases(layer: Layer, run: str, places, skip_first: bool) -> Iterator[Layer]:
    """What a run decodes to from each of its first four characters, if there is more to find; each byte stands for its characters."""
    for phase in range(1 if skip_first else 0, 4):
        text = _decoded(run, phase).decode("latin-1")
        bare = text.replace("\0", "")
        if not (scan(bare) or scan(text) or _BASE64.search(bare) or _PERCENT.search(bare) or _UNICODE.search(bare) or _MAGIC.search(text)):
            continue
        first = [places[phase + 4 * i // 3] for i in range(len(text))]
        last = [places[phase + (4 * i + 3) // 3] for i in range(len(text))]
        yield from _bytes_layers(text, [layer.starts[i] for i in first], [layer.ends[i] for i in last])


def search(text: str, max_inflated: int = MAX_INFLATED) -> tuple[list, list, list, bool]:
    """(base spans, all spans, spans of data that the budget left unread, cut short) of one text; spans are (start, end, kind), sorted."""
    base = sorted(scan(text), key=lambda s: (s[0], s[2], s[1]))
    if not (_BASE64.search(text) or "%" in text or "\\u" in text):
        return base, base, [], False
    found, budget, cut = set(base), [max_inflated], set()
    work, seen = [Layer(text, range(len(text)), range(1, len(text) + 1))], set()
    while work:
        layer = work.pop()
        if layer.text is not text:
            key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
            key.update(f"{layer.starts[0]}:{layer.ends[len(layer.text) - 1]}:{len(layer.text)}".encode())
            if key.digest() in seen:
                continue
            seen.add(key.digest())
            found.update((*layer.span(s, e), k) for s, e, k in scan(layer.text))
            work.extend(_inflated(layer, budget, cut))
        if "%" in layer.text:
            work.append(_unescaped(layer, _PERCENT, _percent))
            raw = _unescaped(layer, _PERCENT, _percent_bytes)
            if raw is not None and _MAGIC.search(raw.text):
                work.append(raw)
        if "\\u" in layer.text:
            work.append(_unescaped(layer, _UNICODE, _unicode))
        work = [x for x in work if x is not None and x.text]
        work.extend(_unwrapped_runs(layer))
    order = lambda spans: sorted(spans, key=lambda s: (s[0], s[2], s[1]))
    return base, order(found), order(cut), budget[0] <= 0


def find_secrets(text: str, max_inflated: int = MAX_INFLATED) -> tuple[list, list, bool]:
    """(base spans, all spans, cut short) of one text; spans are (start, end, kind), sorted."""
    base, found, _, cut = search(text, max_inflated)
    return base, found, cut


def unsafe_spans(text: str, max_inflated: int = MAX_INFLATED) -> list:
    """All spans, and those of data that the budget left unread."""
    _, found, cut, _ = search(text, max_inflated)
    return sorted([*found, *cut])


def masked(text: str, spans: list) -> str:
    """The text with the union of the spans replaced by ``MASK``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns, base and all spans (arrays of start, end, kind) and ``cut_short``.

    One pass over the rows as they lie, nothing shuffled. Null texts count as empty and have no
    spans; repeated rows give repeated results; further columns are left out. Offsets are code
    points, the end exclusive.
    """
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            found = [find_secrets(t) for t in arrow_strings(b.column(len(keep)))]
            named = [pa.array([[(s, e, KINDS[k]) for s, e, k in f[i]] for f in found], kind) for i in (0, 1)]
            cut = pa.array([f[2] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *named, cut], names)

    names = [*keep, "__base", "__all", "__cut"]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    out = map_batches(chosen, run, ", ".join([*schema, f"__base {span}", f"__all {span}", "__cut boolean"]))
    return out.withColumnsRenamed({"__base": "base_spans", "__all": "spans", "__cut": "cut_short"})


def mask_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text masked, a decoded one by its run, and compressed data too long to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_column)
            texts = [t if t is None else masked(t, unsafe_spans(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_batches(docs, run, docs.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document; see ``secret_spans``."""
    found = secret_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text("base_spans").cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        "cut_short",
    )
