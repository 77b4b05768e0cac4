"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

A candidate is a long run of token characters in a sensitive context. Its marginal compressed size is
the size of (context + candidate) less the size of (context), both compressed with a dictionary of
common identifiers and code words. Identifiers, paths and prose are in the dictionary or repeat
their surroundings and cost a few bytes; keys cost about as much as their own information.
"""

from __future__ import annotations

import itertools
import math
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches

KINDS = ("assign", "access", "hex", "novel")

# Patterns of the base kinds (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

SHORTEST = 12  # characters of a candidate: under nine bytes of information are lost in the size of a few more matches
# A name and its value are cut at '='; padding at the end of a run belongs to it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % (SHORTEST - 2), re.A)
CONTEXT = re.compile(r"pass|secret|token|key|auth|cred|bearer|private|sign|salt|session|cookie|login", re.I | re.A)
# A sensitive word within a run, with what else is of its name: what follows is the value.
NAME = re.compile(rf"(?:{CONTEXT.pattern})[A-Za-z]*[_/+-]+", re.I | re.A)
BEFORE, AFTER = 96, 48  # code points of context; a sensitive word must stand in the last REACH before the candidate
REACH, NOVELTY = 48, 0.75
REPEATS = 8  # bytes that a candidate has to cost: one that repeats itself or its surroundings costs fewer, which is much beside the information of twelve digits
RAW = 0.9  # zstandard keeps a few letters as bytes, so letters alone are novel if next to nothing of them is found elsewhere

# Identifiers and words of code and configuration that a key does not consist of (fixed values).
IDENTIFIERS = """
abstract access_token api_key apikey application argument array assert async attribute authorization await
base64 boolean bearer buffer build bytes cache callback charset class client client_id client_secret code
column command config configuration connection const constructor content content-type context continue
cookie count create credentials database date debug decode default define delete description directory
document domain element else encode encoding endpoint environment error event example exception export
extends false field file filename filter final float format from function get global group handler hash
header host http https identifier import include index info input instance integer interface internal item
iterator key keyword label length level library license line list load local localhost login logger main
manager map message method module name namespace network null number object offset option output package
parameter parent parse password path pattern payload permission pointer policy port prefix print private
process profile property protected protocol provider proxy public query queue random read record redirect
reference register release remove render replace report request resource response result return role root
route schema script secret security select self sequence server service session set setting signature size
sort source split start state static status stream string struct suffix switch system table target template
test text thread time timeout timestamp title token true type undefined unicode update upload url user
username utf-8 uuid value variable version view virtual void width window worker write yaml
"""


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches for each kind, failing ones dropped, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Novelty:
    """Compressed sizes with the dictionary; one compressor serves a task."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9):
        words = sorted(set(identifiers.split()))
        forms = [f for w in words for f in (w, w.upper(), w.capitalize(), f'"{w}": "', f"{w} = ")]
        held = zstandard.ZstdCompressionDict("\n".join(forms).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def marginal(self, context: str, candidate: str) -> int:
        c = context.encode("utf-8", "surrogatepass")
        return len(self._compress(c + candidate.encode())) - len(self._compress(c))

    def marginals(self, before: str, after: str, candidate: str) -> int:
        """The larger of the marginal bytes after what stands before, and after that and what follows.

        Some twenty bytes more can make the compressor code all literals in another way, which hides a candidate's cost behind its context's; it seldom does so in both.
        """
        return max(self.marginal(before, candidate), self.marginal(before + after, candidate))

    @staticmethod
    def information(candidate: str) -> float:
        """Bytes that random characters of the same classes hold."""
        if re.fullmatch(r"[0-9]+", candidate):
            letters = 10
        elif re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
            letters = 16
        elif re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", candidate):
            letters = 36
        elif candidate.isalpha():
            letters = 52
        else:
            letters = 64
        return len(candidate) * math.log2(letters) / 8

    def ratio(self, before: str, candidate: str, after: str = "") -> float:
        """Marginal bytes for each byte of information."""
        return self.marginals(before, after, candidate) / self.information(candidate)


def telling(s: str) -> bool:
    """Strings that their cost alone judges: digits, letters with an eighth of digits and more, or letters that change case more often than those of joined words do."""
    digits, letters = sum(c.isdigit() for c in s), [c for c in s if c.isalpha()]
    if digits == len(s) or len(letters) >= 4 and 8 * digits >= len(s):
        return True
    return len(letters) > 1 and 8 * sum(x.islower() != y.islower() for x, y in itertools.pairwise(letters)) >= 3 * (len(letters) - 1)


def measurable(s: str) -> bool:
    """All but letters of one case: a few bytes of them are random or a word that isn't in the dictionary, which compression can't tell."""
    letters = "".join(c for c in s if c.isalpha())
    return any(c.isdigit() for c in s) or not (letters.islower() or letters.isupper() or letters.istitle()) and bool(letters)


def candidates(text: str):
    """Start and end of each run to be looked at, and whether it stands in a sensitive context."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < SHORTEST:
            continue
        near = bool(CONTEXT.search(text, max(0, a - REACH), a))
        if not near:
            # The key's own name may be the start of the run.
            for name in NAME.finditer(text, a, b - SHORTEST):
                near, a = True, name.end()
        yield a, b, near


def scan(text: str, novelty: Novelty, least: float = NOVELTY) -> tuple[list, list, float | None]:
    """Base spans, all spans, and the largest ratio among the candidates measured."""
    base = base_spans(text)
    more, most = [], None
    for a, b, near in candidates(text):
        s = text[a:b]
        covered = any(x < b and a < y for _, x, y in base)
        if not covered and not (near and measurable(s)):
            continue
        cost = novelty.marginals(text[max(0, a - BEFORE) : a], text[b : b + AFTER], s)
        r = cost / novelty.information(s)
        most = r if most is None or r > most else most
        if not covered and r >= least and cost >= REPEATS and (telling(s) or cost >= RAW * len(s)):
            more.append(("novel", a, b))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))), most


DDL = "id bigint, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, novelty double"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """One row for each row of docs: id, base, spans (base and novel), novelty (null without a candidate).

    Offsets are code points, ends exclusive; spans go by start, then kind, so spans of two kinds over the same place are both there. Null text
    counts as empty and has none; ids may be null or repeated; an empty table gives an empty result; other columns are ignored. Very
    long texts are read whole, in time that grows with their length; a candidate is compressed twice with what stands around it.
    """

    def start():
        novelty = Novelty()
        pack = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        def work(batch):
            rows = [scan(t or "", novelty, least) for t in batch["text"]]
            return {"id": batch["id"], "base": [pack(r[0]) for r in rows], "spans": [pack(r[1]) for r in rows], "novelty": [r[2] for r in rows]}

        return work

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), start, DDL)
