"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one bit string that spans as many 64-bit words
as it needs. A rule of ``m`` symbols owns ``m + 1`` neighbouring bits, one for
each number of symbols read. One step for the byte ``c`` is Shift-And with
loops::

    D = ((D << 1) & step[c]) | (D & stay[c])

where ``step[c]`` has the bits whose symbol accepts ``c`` and ``stay[c]`` those
that stand before a star. The shift carries over the word ends; what runs from
one rule into the next is masked away, because first bits are in no ``step``.
So all rules move together, for all URLs of a batch at once.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte. They match
the whole canonical URL: host in lower case followed by the path.

Defined results: a null url, or one without ``://``, has an empty host and path;
an empty canonical URL matches only globs of stars. Rows are judged one by one,
so repeated rows give repeated results and ties cannot arise: of rules of equal
length the first in the list wins. Rows are never dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexalign.llm.common import per_batch, table

#: Fixed values of the production filter: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Globs that block a URL which no rule fits.
BLOCK_GLOBS = ["**/wp-admin/**", "**/cgi-bin/**", "**/wp-login.php", "**.exe", "*.onion/**", "*casino*/**"]

#: Bytes of the padded matrix of one step over URLs of like length.
MATRIX_BYTES = 1 << 24


class GlobAutomaton:
    """The packed masks of a list of globs and their simulation."""

    def __init__(self, globs: list[str]):
        symbols: list[tuple[int | None, bool]] = []   # (byte or None for any, is a first bit)
        stays: list[str] = []                         # "", "*" or "**" at each bit
        accept = []
        for glob in globs:
            raw, i = glob.encode(), 0
            symbols.append((None, True))
            stays.append("")
            while i < len(raw):
                if raw[i:i + 2] == b"**":
                    stays[-1], i = "**", i + 2
                elif raw[i:i + 1] == b"*":
                    stays[-1], i = stays[-1] or "*", i + 1
                else:
                    symbols.append((None if raw[i:i + 1] == b"?" else raw[i], False))
                    stays.append("")
                    i += 1
            accept.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.accept = np.array(accept, dtype=np.int64)
        step = np.zeros((256, self.words * 64), dtype=bool)
        stay = np.zeros((256, self.words * 64), dtype=bool)
        first = np.zeros((1, self.words * 64), dtype=bool)
        for bit, (symbol, is_first) in enumerate(symbols):
            if is_first:
                first[0, bit] = True
            elif symbol is None:
                step[:, bit] = True
            else:
                step[symbol, bit] = True
            if stays[bit]:
                stay[:, bit] = True
                if stays[bit] == "*":
                    stay[ord("/"), bit] = False
        self.step, self.stay, self.first = map(self._pack, (step, stay, first))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: URLs by globs."""
        out = np.zeros((len(urls), len(self.accept)), dtype=bool)
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, int(lengths[order[at]]))
            block = order[at:at + max(1, MATRIX_BYTES // longest)]
            out[block] = self._simulate([urls[i] for i in block], lengths[block])
            at += len(block)
        return out

    def _simulate(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """``urls`` with the longest first, so that those still running are always a prefix."""
        longest = int(lengths[0])
        text = np.frombuffer(b"".join(u.ljust(longest, b"\0") for u in urls), dtype=np.uint8).reshape(len(urls), longest)
        state = np.repeat(self.first, len(urls), axis=0)
        running = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for i in range(longest):
            n = running[i]
            now, seen = state[:n], text[:n, i]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (shifted & self.step[seen]) | (now & self.stay[seen])
        return ((state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None,
               block_globs: list[str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the longest fitting rule and the verdict of every row.

    A rule ``(host, path, verdict)`` fits its host and all subdomains, if the
    path starts with the rule's. Where none fits, the verdict is ``block`` if a
    glob of ``block_globs`` matches, else ``allow``. One pass over two columns,
    no shuffle; the masks (a few KB) travel in the closure.
    """
    rules = RULES if rules is None else rules
    globs = BLOCK_GLOBS if block_globs is None else block_globs
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    n = len(by_length)
    packed = [f"{h}{p}**" for h, p, _ in by_length] + [f"*.{h}{p}**" for h, p, _ in by_length] + list(globs)
    names = [h + p for h, p, _ in by_length] + [None]
    verdicts = [v for _, _, v in by_length]
    id_type = pages.schema[id_col].dataType.simpleString()

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = GlobAutomaton(packed)
        parts = [split_url(u or b"") for u in batch.column(1).cast(pa.large_binary()).to_pylist()]
        hit = automaton.matches([h + p for h, p in parts])
        fits = np.concatenate([hit[:, :n] | hit[:, n:2 * n], np.ones((len(parts), 1), dtype=bool)], axis=1)
        rule = fits.argmax(axis=1)
        blocked = hit[:, 2 * n:].any(axis=1)
        return pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([h.decode("utf-8", "replace") for h, _ in parts], pa.string()),
            pa.array([p.decode("utf-8", "replace") for _, p in parts], pa.string()),
            pa.array([names[r] for r in rule], pa.string()),
            pa.array([verdicts[r] if r < n else "block" if b else "allow" for r, b in zip(rule, blocked)], pa.string()),
        ], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(
        per_batch(judge), f"page_id {id_type}, host string, path string, rule string, verdict string")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the production rules."""
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rverdict
            WHEN contains(host || path, '/wp-admin/') OR contains(host || path, '/cgi-bin/')
              OR ends_with(host || path, '/wp-login.php') OR ends_with(host || path, '.exe')
              OR (ends_with(host, '.onion') AND starts_with(path, '/'))
              OR (contains(host, 'casino') AND starts_with(path, '/')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""
