"""Template residue and error pages: slots are induced by aligning records, pages by their repeated skeletons.

A first pass over the texts finds *signs*: values that a template engine should have replaced (variable names in any of the
usual delimiters), defaults printed as text (``undefined``, ``None``, ...), stand-in lines and filler. Each sign is keyed by the constant text
it stands in: a value by the two tokens on either side of it in its line (line ends are tokens), a line by the line before it with numbers
masked. Records made from one template share those keys.

A second pass aligns all records on the keys: wherever any text has the same surroundings, it reports the value that stands
between them. Only keys set in a bitmap of fixed size (``bitmap_bits``, made from the signs' keys) are reported, so the pass sends little and
nothing grows with the collection; keys that merely share a bit are dropped by the join that follows.

A key with different values is a slot of a template, one that always has the same word (prose *about* null values) is constant
text. A sign in a slot is flagged. Signs whose surroundings occur once cannot be aligned; of them those count whose form alone decides
(a delimited name in running text, a line that is nothing but a stand-in). ``route`` says which of the two it was.

Whole pages are reduced to a skeleton (numbers, hashes, paths and names masked, navigation and footers dropped). A page
counts when its skeleton recurs in several records with different texts, or if its wording says that it is an error page once those lines are
dropped, whatever its length (``says_error``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.wordhash import U64, byte_batches, mix, range_hashes
from sparkloom.session import materialise, widen

_NAME = r"[A-Za-z][\w .:-]{0,40}?"
FIELD = re.compile(
    r"\{\{-?\s*" + _NAME + r"\s*-?\}\}"
    r"|\{%-?\s*[^%\n]{1,80}%\}(?:\s*\{%[^%\n]{1,80}%\})*"
    r"|\$\{" + _NAME + r"\}"
    r"|<%[=-]?\s*" + _NAME + r"\s*-?%>"
    r"|\[\[\s*" + _NAME + r"\s*\]\]"
    r"|<<\s*" + _NAME + r"\s*>>"
    r"|#\{" + _NAME + r"\}"
    r"|%\([A-Za-z_]\w*\)[sdif]"
    r"|\b__[A-Z][A-Z0-9_]*__\b"
    r"|@[A-Z][A-Z0-9_]{2,}@"
    r"|\bTODO_[A-Z][A-Z0-9_]*\b"
    r"|\[(?i:insert|your|enter|add|fill in|put|replace(?: with)?)\b[^\]\n]{0,50}\]"
    r"|<(?i:your|insert|enter|add|put|replace)\b[ _-][^>\n]{0,50}>"
    r"|%%[A-Z][A-Z0-9_]*%%"
)
BRACE = re.compile(r"(?<![\w$#{%/])\{[a-z][a-z0-9_ ]{1,40}\}(?!\})")
DEFAULT = re.compile(r"\[object Object\]|<no value>|(?<![\w`'\"./-])(?:undefined|NaN|None|null|nil|Null|NULL)(?![\w`'\"/-])")
STAND_IN = re.compile(
    r"(?:\W*(?:"
    r"(?:tbd|tba|tbc|tbw|fixme|xxx|todo|n/?a|\?{2,}|\.{3}|placeholder(?: text)?|dummy text|sample text|text goes here|content goes here)"
    r"|(?:to be|will be) (?:written|added|done|completed|defined|announced|continued|documented|filled in|determined|decided|provided|described)(?: (?:later|soon))?"
    r"|(?:please )?(?:fill|fill me|fill this) in(?: (?:later|here|this section))?"
    r"|add (?:some |your )?(?:text|content|description|details?|documentation)(?: here)?"
    r"|(?:describe|document|explain|insert|write|put|enter|add|summari[sz]e) [\w ]{1,40}\bhere"
    r"|(?:todo|fixme|xxx|tbd)\b[:\s-]*(?:write|document|describe|add|fill|complete|explain|finish|insert|summari[sz]e)\b[\w ,]{0,40}"
    r"|(?:this |the )?(?:section|page|chapter|paragraph|documentation)(?: is| has)? (?:intentionally )?(?:left blank|left empty|empty|under construction|not (?:yet )?(?:been )?(?:written|available|documented)(?: yet)?)"
    r"|coming soon|under construction|content (?:will follow|follows|pending)|nothing here yet|work in progress|no (?:description|content|text) (?:yet|provided|available)"
    r")\W*)",
    re.IGNORECASE,
)
#: The stems of the usual filler text.
LATIN = (
    "lorem ipsum dolor sit amet consec tetur adip elit sed eius temp incid labor magna aliq enim minim veni quis nostr exercit ullam "
    "nisi commo consequ duis aute irur reprehend volupt velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum modis "
    "comm cons sit vel mod eiusm temporincididunt ut et"
).split()
_LATIN = re.compile(r"(?:" + "|".join(sorted(LATIN, key=len, reverse=True)) + r")\w{0,4}")
_QUICK = re.compile(r"[{}<\[%@$#]|__[A-Z]|TODO|undefined|NaN|None|null|nil|NULL|Null|(?i:lorem|ipsum)")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_LEAD = re.compile(r"^[\s>*#+\-|•]*(?:\d+[.)]\s+)?")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|func|fn|pub|public|private|export|const|let|var|return|if|for|while|import|from|package|@\w+|#\[|function|async|\}|\)).*[(){};:=]|==|=>|\breturn\b|\s=\s|\w\([^)]*\)\s*[;{]?$")
_COMMENT = re.compile(r"^\s*(?://|/\*|\*/|\"\"\"|'''|--\s|<!--)")
_TOKEN = re.compile(rb"[a-z0-9_\x80-\xff]+|[^\sa-z0-9_\x80-\xff]")
_EDGE = b"\x01"
_GAPS = (1, 2, 3)

NAV = re.compile(
    r"^\s*(?:[\w .&-]{1,30}(?:\s[|·»/]\s[\w .&-]{1,30})+|skip to (?:main )?content|(?:\(c\)|©|copyright)\s.*|(?:cf-)?ray id:?\s*\w+|(?:request|trace|error|incident|reference) id:?\s*[\w-]+"
    r"|[\w.-]+/\d[\w.]*(?:\s[\w./-]+)?|e-?mail(?: address)?|password|user ?name|forgot(?:ten)? (?:your )?password\??|powered by .*|(?:accept all|reject|settings|ok|back|home|retry|reload|continue|sign up|register)\W*)\s*$",
    re.IGNORECASE,
)
STACK = re.compile(r"^\s*(?:at\s+[\w.$<>]+\s*\(.*\)|File \".*\", line \d+.*|\.\.\. \d+ more|caused by:.*|traceback .*)\s*$", re.IGNORECASE)
STRONG = re.compile(
    r"^(?:http(?:/[\d.]+)?\s*)?(?:error\s*)?(?:code\s*)?[45]\d\d\b(?!\s*(?:times|calls|rows|ms))|\b(?:page|url|file|resource|document|entry|eintrag|seite|pagina|p.gina|page)\b.{0,60}\b(?:not found|was not found|does not exist|no longer exists|nicht gefunden|existiert nicht|n[oa]o? (?:foi )?encontrad[ao]|introuvable|n'existe|non trovata|not available)"
    r"|^(?:not found|access (?:is |was )?denied|permission denied|forbidden|unauthori[sz]ed|zugriff verweigert|acc[eè]s refus[eé]|acceso denegado|acesso negado)"
    r"|do(?:es)? not have (?:access|permission)|(?:page|space|site|repository) is private|ask an owner"
    r"|^(?:please )?(?:log|sign) ?-?in (?:to|again|first|required)|^(?:login|sign-in) required|session (?:has|is) (?:expired|timed out)|^bitte (?:melden sie sich|anmelden)|^(?:connectez-vous|inicie sesi[oó]n|fa[cç]a login)"
    r"|not a robot|you are (?:a )?human|verify (?:that )?you|verify your browser|checking (?:that|your browser|if)|captcha|unusual traffic"
    r"|accept (?:all )?cookies|we (?:and our partners )?use cookies|cookies? (?:consent|settings|akzeptieren)|acept(?:e|ar) (?:las )?cookies|accepte[rz]? les cookies"
    r"|(?:enable|turn on|activer|habilitar|activar|aktivieren|ativar|requires?|needs?) (?:java ?)?scripts?\b|javascript (?:is |must be )?(?:disabled|required|enabled|aktivieren)|(?:java ?script).{0,30}(?:aktivieren|einschalten)|does not (?:run|support) (?:java ?)?scripts?|\bjavascript\b"
    r"|(?:rate limit|quota) (?:was )?exceeded|^too many requests|slow down and|quota (?:is )?(?:used up|exhausted)|come back (?:later|tomorrow)"
    r"|(?:unhandled|uncaught|server-side|internal) exception|^(?:fatal|application) error|^fatal:|^exception in|^(?:whoops|oops|sorry)\b|something went wrong|(?:internal )?server error|service (?:is )?(?:temporarily )?unavailable|bad gateway|gateway time-?out|could not complete your request|an error (?:has )?occurred|try again later|ein fehler ist aufgetreten|une erreur|ha ocurrido un error|ocorreu um erro|erro interno|error interno|erreur interne|interner fehler|tente novamente|int[eé]ntelo|r[eé]essayez|versuchen sie es"
    r"|^coming soon|under construction|nothing here yet|(?:page|section) is intentionally left blank|content will follow|check back (?:later|soon)|has not been written|not (?:yet )?been written|im aufbau|en (?:construction|construcci[oó]n)|em constru[cç][aã]o|noch nicht geschrieben"
    r"|^\{?\s*\"?(?:error|errors|fault|exception)\"?\s*:|\"status\"\s*:\s*\"?(?:fail|error|[45]\d\d)|\"message\"\s*:\s*\"?(?:not found|forbidden|unauthori|bad|access|internal|rate)|\"code\"\s*:\s*\"?[45]\d\d",
    re.IGNORECASE,
)
WEAK = re.compile(r"\b(?:error|denied|expired|missing|unavailable|blocked|forbidden|login|disabled|maintenance|wartung|fehler|erreur|fallo|erro|gone|offline|redirect(?:ing)?|loading|please wait|einen moment|patientez)\b", re.IGNORECASE)
BARRIER = re.compile(r"\b(?:cookies?|consent|privacy|partners|preferences|vendors|legitimate interests?|personal data|withdraw|third parties|advertising|log ?in|sign ?in|javascript|browser|robot|captcha|permission|administrator|exception|stack ?trace|not found|no longer|try again|refresh)\b", re.IGNORECASE)

EVIDENCE = "doc_id bigint, what string, sure boolean, context bigint, fill bigint, line int"


def _h(x: str) -> int:
    v = xxhash.xxh64_intdigest(x)
    return v - (1 << 64) if v >= 1 << 63 else v


Frame = tuple[bytes, bytes, bytes, bytes]


def _frame(line: str, a: int, b: int) -> Frame:
    """The two constant tokens before and after line[a:b]; other signs in the line count as one token, so do the line's ends."""
    left, right = (DEFAULT.sub("\x02", FIELD.sub("\x02", x)).lower().encode("utf-8", "surrogatepass") for x in (line[:a], line[b:]))
    return (*[_EDGE, _EDGE, *_TOKEN.findall(left)][-2:], *[*_TOKEN.findall(right), _EDGE, _EDGE][:2])


def _line_key(before: str) -> int:
    return _h("line\x00" + re.sub(r"\d+", "9", before.strip().lower()))


def frame_keys(frames: list[Frame]) -> np.ndarray:
    """The hash of each frame, the same that ``aligned_values`` computes from running text."""
    flat = [t for f in frames for t in f]
    buf = np.frombuffer(b"".join(flat) or b"\0", dtype=np.uint8)
    ends = np.cumsum([len(t) for t in flat], dtype=np.int64)
    h = range_hashes(buf, ends - np.array([len(t) for t in flat], dtype=np.int64), ends).reshape(-1, 4)
    return _combine(h[:, 0], h[:, 1], h[:, 2], h[:, 3]).view(np.int64)


def _combine(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return mix(((a * U64(0x9E3779B97F4A7C15) + b) * U64(0xC2B2AE3D27D4EB4F) + c) * U64(0x165667B19E3779F9) + d)


_WORDBYTE, _SPACEBYTE = np.zeros(256, bool), np.zeros(256, bool)
_WORDBYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True
_SPACEBYTE[[*b" \t\n\r\f\v"]] = True


def aligned_values(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of every place in the texts whose surroundings have a key set in the bitmap, each pair once."""
    parts = [b"\x01 \x01 " + "\x01 \x01 ".join(t.replace("\r\n", "\n").split("\n")).lower().encode("utf-8", "surrogatepass") + b" \x01 \x01" for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    word = _WORDBYTE[buf]
    lone = ~word & ~_SPACEBYTE[buf]
    starts = np.flatnonzero((word & ~np.concatenate([[False], word[:-1]])) | lone)
    ends = np.flatnonzero((word & ~np.concatenate([word[1:], [False]])) | lone) + 1
    h = range_hashes(buf, starts, ends)
    edge = buf[starts] == 1
    inner = np.concatenate([[0], np.cumsum(edge)])
    keys, values = [], []
    for g in _GAPS:
        n = len(h) - g - 3
        if n <= 0:
            break
        k = _combine(h[:n], h[1 : n + 1], h[2 + g : n + 2 + g], h[3 + g : n + 3 + g])
        ok = np.flatnonzero(_in_bitmap(k, wanted) & (inner[2 + g : n + 2 + g] == inner[2 : n + 2]))
        v = h[2 + ok].copy()
        for j in range(1, g):
            v = mix(v * U64(0x9FB21C651E98DF25) + h[2 + j + ok])
        keys.append(k[ok])
        values.append(v)
    pairs: set[tuple[int, int]] = set()
    for t in texts:
        lines = [x for x in map(str.strip, t.split("\n")) if x]
        for x, y in zip(lines, lines[1:], strict=False):
            k = _line_key(x)
            if wanted[(k >> 6) & (len(wanted) - 1)] >> U64(k & 63) & U64(1):
                pairs.add((k, _h(y)))
    if pairs:
        p = np.array(sorted(pairs), np.int64)
        keys.append(p[:, 0].view(U64))
        values.append(np.ascontiguousarray(p[:, 1]).view(U64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(keys), np.concatenate(values)], axis=1), axis=0)
    return both[:, 0].view(np.int64), both[:, 1].view(np.int64)


def _in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    k = keys.view(U64)
    return (bitmap[((k >> U64(6)) & U64(len(bitmap) - 1)).astype(np.int64)] >> (k & U64(63))) & U64(1) == 1


_MASKED = re.compile(r"(?<![\w-])[A-Za-z_\-\u0080-\uffff]*+(?:\d[\w-]*+|(?:\.[\w-]++)++)|(?<!\w)/[\w/.-]++")


@lru_cache(maxsize=200_000)
def _is_latin(word: str) -> bool:
    return len(word) > 2 and _LATIN.fullmatch(word) is not None


def page_skeleton(lines: list[str]) -> tuple[str, list[str]]:
    """The page without navigation, footers and stack frames, and its skeleton with names and numbers masked."""
    core = [x.strip().lstrip("#").lstrip() or "#" for x in lines if x.strip() and not NAV.match(x) and not STACK.match(x)]
    return _MASKED.sub("9", "\n".join(core)).lower(), core


def says_error(core: list[str], heading: bool) -> bool:
    """Whether the wording alone makes a page an error or barrier page, of whatever length.

    A short page of short sentences says so anywhere (in its title if it has a heading); any other page in its title, and at
    least half of its sentences speak of it.
    """
    parts = [s for x in core for s in (re.split(r"(?<=[.!?])\s+", x) if not x.startswith("{") else [x])]
    title = STRONG.search(parts[0]) is not None
    if (title or not heading) and sum(len(x.split()) for x in core) <= 60 and all(len(s.split()) <= 13 for s in parts):
        return any(STRONG.search(s) for s in parts)
    if not title or len(parts[0].split()) > 13 or len(parts) < 2:
        return False
    return 2 * sum(bool(STRONG.search(s) or WEAK.search(s) or BARRIER.search(s)) for s in parts) >= len(parts)


def filler(content: str) -> bool:
    """Whether a line, one of its sentences or any twelve words in a row are mostly filler."""
    words = [x.strip(".,;:!?").lower() for x in content.split()]
    if len(words) < 6:
        return False
    latin = [_is_latin(x) for x in words]
    if sum(latin) < 4:
        return False
    n = len(content[:160].split())
    if n >= 6 and sum(latin[:n]) >= 0.55 * n:
        return True
    upto = [0, *accumulate(latin)]
    if any(upto[k + 12] - upto[k] >= 7 for k in range(len(words) - 11)):
        return True
    at = 0
    for k, x in enumerate(content.split(), 1):
        if x[-1] in ".!?" or k == len(words):
            if k - at >= 6 and upto[k] - upto[at] >= 0.55 * (k - at):
                return True
            at = k
    return False


def inspect(text: str, listing: bool) -> Iterator[tuple[str, bool, int | Frame, int, int]]:
    """(what, sure, key or surroundings, value, line number) for every sign in one text."""
    lines = text.replace("\r\n", "\n").lstrip("\ufeff").split("\n")
    listing = listing and sum(bool(_CODE.search(x)) for x in lines) >= 0.3 * sum(bool(x.strip()) for x in lines)
    if not listing:
        skeleton, core = page_skeleton(lines)
        if core:
            yield "error_page", says_error(core, any(x.startswith("# ") for x in lines)), _h("page\n" + skeleton), _h(" ".join(text.lstrip("\ufeff").split())), 1
    fence, block, last, before = False, False, "", ""
    for no, line in enumerate(lines, 1):
        if line.strip():
            last, before = line, last
        if _FENCE.match(line):
            fence = not fence
            continue
        bare = line.strip()
        if not bare:
            continue
        if bare.startswith("/*") or (bare[:3] in ('"""', "'''") and bare.count(bare[:3]) == 1):
            block = True
        code = fence or listing or block or bool(_COMMENT.match(line))
        if block and (bare.endswith("*/") or (bare[-3:] in ('"""', "'''") and len(bare) > 3)):
            block = False
        content = _LEAD.sub("", bare)
        if not content:
            continue
        if not code and STAND_IN.fullmatch(content):
            nxt = next((x for x in lines[no : no + 3] if x.strip()), "")
            if not (bare[0] in "#*" and _CODE.search(nxt) and not nxt.startswith("#")):
                yield "stand_in", True, _line_key(before), _h(bare), no
                continue
        if filler(content):
            yield "filler", True, _line_key(before), _h(bare), no
            continue
        if not _QUICK.search(line):
            continue
        quoted = [(m.start(), m.end()) for m in re.finditer(r"`[^`\n]+`", line)]
        for m in FIELD.finditer(line):
            a, b = m.span()
            inside = next(((x, y) for x, y in quoted if x < a and b < y), None)
            if inside and (inside[0] + 1, inside[1] - 1) == (a, b):
                continue  # quoted by itself: the text speaks about it
            alone = content == m.group(0) or re.fullmatch(r"[\W_]*", _LEAD.sub("", (line[:a] + line[b:]).strip())) is not None
            yield "field", alone or not code, _frame(line, a, b), _h(m.group(0)), no
        if code:
            continue
        for m in BRACE.finditer(line):
            if any(x <= m.start() < y for x, y in quoted) or bare.startswith(("### GET", "### POST", "### PUT", "### DELETE", "### PATCH")):
                continue
            yield "field", content == m.group(0), _frame(line, *m.span()), _h(m.group(0)), no
        found = [m for m in DEFAULT.finditer(line) if not any(x <= m.start() < y for x, y in quoted)]
        if found and not _CODE.search(line):
            rest = DEFAULT.sub(" ", line)
            only = not re.search(r"\w", rest)
            keyed = len(found) == 1 and re.fullmatch(r"[\w ]{1,30}:\s*", line[: found[0].start()].strip(" -*>#") + " ") is not None and not line[found[0].end() :].strip(" .")
            for m in found:
                yield "default", only or keyed, _frame(line, *m.span()), _h(m.group(0)), no


def _texts(docs: DataFrame, doc_id: str, text: str, kind: str | None) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"),
        (F.coalesce(F.col(kind) == "source_listing", F.lit(False)) if kind else F.lit(False)).alias("listing"),
    ).where("d is not null and t is not null")


def residue_evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = "kind") -> DataFrame:
    """All signs found, with the keys and values that the alignment needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[d, *e] for d, t, listing in zip(*(c.to_pylist() for c in b.columns), strict=True) for e in inspect(t, listing)]
            if rows:
                framed = [r for r in rows if not isinstance(r[3], int)]
                for r, k in zip(framed, frame_keys([r[3] for r in framed]).tolist() if framed else [], strict=True):
                    r[3] = k
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), *(pa.array(np.array(c, np.int64)) for c in cols[3:5]), pa.array(cols[5], pa.int32())],
                    names=[c.split()[0] for c in EVIDENCE.split(", ")],
                )

    return widen(_texts(docs, doc_id, text, kind)).mapInArrow(run, EVIDENCE)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of the keys; at most bits / 64 rows come to the driver, however many keys there are."""
    words = keys.select(F.expr(f"shiftrightunsigned(context, 6) & {bits // 64 - 1}L").alias("w"), F.expr("shiftleft(1L, cast(context & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=U64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(U64)
    return out


def observed_values(docs: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text", bitmap_bits: int = 1 << 24) -> DataFrame:
    """``(context, value)``: what stands in all texts where one of the keys' surroundings does (and where a key shares a bit)."""
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, bitmap_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in byte_batches(texts):
                k, v = aligned_values(texts[lo:hi], bitmap)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["context", "value"])

    return widen(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null").select("t")).mapInArrow(run, "context bigint, value bigint")


def template_residue(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = "kind", min_pages: int = 3, min_values: int = 4, bitmap_bits: int = 1 << 24, salts: int = 8
) -> DataFrame:
    """``(doc_id, what, line, route)`` for each confirmed sign of template residue; what: field, default, stand_in, filler or error_page.

    A sign's surroundings are a slot if at least two different signs or ``min_values`` different values stand in them over the corpus. Signs
    in a slot have the route ``slot``; values that are rather words (``None`` in a sentence) need two different signs there. The skeleton of a page must occur
    in ``min_pages`` records with at least two different texts (route ``page``). Signs whose form decides count with the route ``form`` otherwise.
    Rows without id or text take no part, empty texts have no signs, repeated rows are found each. ``kind`` names the column whose value
    ``source_listing`` marks code; None if there is none. Signs are dealt to ``salts`` parts of each slot, so a template behind a third of all
    rows is no single task.
    """
    ev = materialise(residue_evidence(docs, doc_id, text, kind), "residue")
    signs = ev.where("what <> 'error_page'")
    keys = signs.select("context").distinct()
    seen = observed_values(docs, keys, doc_id, text, bitmap_bits).groupBy("context").agg(F.approx_count_distinct("value").alias("values"))
    own = signs.groupBy("context").agg((F.min("fill") != F.max("fill")).alias("varied"))
    slots = own.join(seen, "context", "left").select("context", "varied", (F.col("varied") | (F.coalesce("values", F.lit(0)) >= min_values)).alias("slot")).where("slot")
    dealt = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    spread = lambda df: df.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    in_slot = dealt(signs).join(spread(slots), ["context", "salt"], "left")
    found = in_slot.where("sure or varied").select("doc_id", "what", "line", F.when(F.col("slot"), "slot").otherwise("form").alias("route"))
    pages = ev.where("what = 'error_page'")
    often = (
        pages.groupBy("context").agg(F.count("*").alias("n"), F.min("fill").alias("lo"), F.max("fill").alias("hi"))
        .where((F.col("n") >= min_pages) & (F.col("lo") != F.col("hi"))).select("context", F.lit(True).alias("slot"))
    )
    whole = dealt(pages).join(spread(often), ["context", "salt"], "left").where("sure or slot")
    return found.unionByName(whole.select("doc_id", "what", "line", F.when(F.col("slot"), "page").otherwise("form").alias("route")))


def found_documents(residue: DataFrame) -> DataFrame:
    return residue.select("doc_id").distinct()


def without_residue(docs: DataFrame, residue: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without residue; rows without an id stay."""
    return docs.join(residue.select(F.col("doc_id").alias("__residue")).distinct(), F.col(doc_id) == F.col("__residue"), "left_anti")
