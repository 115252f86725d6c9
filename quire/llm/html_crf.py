"""Main-text extraction with a linear-chain conditional random field (free style: Arrow UDF).

A page is read into its leaf blocks: runs of text between block-level tags, each
with the tags, classes, ids and roles above it.  A linear-chain CRF labels the
blocks as main text or not, from ancestor-tag and text features and from the label
of the block before; Viterbi decoding picks the best labelling of the page.  The
weights are trained here, by gradient ascent on the exact log-likelihood
(forward-backward), on labelled pages that ``labelled_pages`` builds from a rule.

The text of a page is its main blocks in page order, joined by newlines: character
references decoded, white space inside a block made one space, ends trimmed.
Scripts, styles, templates, the document head and comments of the markup never
yield blocks.  ``<br>`` is white space.

Defined cases: null html counts as empty; a page without blocks has empty text;
markup that ends early is read as far as it goes: a head ends at the first thing
that cannot stand in one, a skipped element without its own end tag is read, and only
script, style and textarea take the rest of the page; a ``<`` that opens no tag is
text; repeated rows get equal texts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (element classes of HTML) ----
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr br "
                    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup "
                    "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Without an end tag, these take the rest of the page.
RAW = frozenset("script style textarea".split())
#: Dropped when their own end tag closes them, else read.
SKIPPED = frozenset("template noscript svg iframe object canvas audio video select annotation annotation-xml".split())
#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("head title base basefont bgsound link meta script style noscript noframes template".split())
CLOSES_P = frozenset(("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul").split())
CUES = ("cookie", "subscribe", "newsletter", "comment", "reply", "share", "copyright", "advert", "sponsor", "log in", "sign",
        "related", "privacy", "terms", "all rights", "read more", "menu", "search", "follow", "posted", "©")

# A quote opens a value only behind an equals sign; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=\s*+[^\s\"'>][^\s>]*+|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Open:
    """An open element.  What blocks ask of the elements above them is kept here, shared with
    the element above where nothing new comes, so a block costs the same at any depth."""
    __slots__ = ("tag", "up", "mark", "in_link", "base", "inside", "names", "pair", "depth")

    def __init__(self, tag: str, up: "_Open | None", at: int, names: tuple[str, ...] = (), mark: int = 0, in_link: int = 0):
        self.tag, self.up = tag, up
        self.mark, self.in_link = mark, in_link         # blocks and link state before a skipped element
        if up is None:
            self.base, self.inside, self.names, self.pair, self.depth = -1, frozenset(), frozenset(), (), 0
            return
        #: Distinct block-level tags and class, id and role words from the root to here.
        self.inside, self.names = up.inside, up.names
        if tag in INLINE:
            #: Place on the stack of the innermost element that is not inline.
            self.base, self.pair, self.depth = up.base, up.pair, up.depth
        else:
            self.base, self.pair, self.depth = at, (*up.pair[-1:], tag), up.depth + 1
            if tag not in self.inside:
                self.inside |= {tag}
        if names and not self.names.issuperset(names):
            self.names = self.names.union(names)


_ROOT = _Open("", None, -1)


@dataclass
class Block:
    text: str
    place: _Open                    # the innermost open element
    linked: int                     # characters inside links

    @property
    def tags(self) -> tuple[str, ...]:
        """Block-level ancestors, outermost first."""
        out, o = [], self.place
        while o is not _ROOT:
            if o.tag not in INLINE:
                out.append(o.tag)
            o = o.up
        return tuple(out[::-1])

    @property
    def names(self) -> frozenset[str]:
        """Class, id and role words of the ancestors."""
        return self.place.names


def _closing(page: str, tag: str, at: int) -> re.Match | None:
    return re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)


def _head_end(page: str, at: int) -> int:
    """Where a head that starts before ``at`` ends: its end tag may be left out."""
    unclosed = set()
    while True:
        m = _TOKEN.search(page, at)
        if page[at:m.start() if m else len(page)].strip() or not m:
            return at
        tag = (m[2] or "").lower()
        if m[1] and tag == "head":
            return m.end()
        if tag in ("body", "html", "br") if m[1] else tag and tag not in IN_HEAD:
            return m.start()
        at = m.end()
        if not m[1] and tag in ("title", "script", "style", "noscript", "noframes", "template"):
            if tag not in unclosed and (end := _closing(page, tag, at)):
                at = end.end()
                continue
            unclosed.add(tag)
            if tag in RAW:
                return len(page)
            if tag == "title":
                at = (m.start() if (m := _TOKEN.search(page, at)) else len(page))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()              # open elements by tag
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, stack[-1] if stack else _ROOT, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def enter(tag: str, *about):
        stack.append(_Open(tag, stack[-1] if stack else _ROOT, len(stack), *about))
        count[tag] += 1

    def leave(to: int):
        count.subtract(o.tag for o in stack[to:])
        del stack[to:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        add(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                flush()
            if count[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                if tag in SKIPPED:
                    del out[stack[i].mark:]
                    in_link = stack[i].in_link
                leave(i)
            continue
        if tag == "head" or tag in RAW or tag in SKIPPED:
            flush()
            if m[3].endswith("/"):
                continue
            if tag == "head":
                at = _head_end(page, at)
            elif tag in RAW:
                end = _closing(page, tag, at)
                at = end.end() if end else len(page)
            else:
                enter(tag, (), len(out), in_link)
            continue
        if tag == "br" or tag in ("img", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                base = (stack[-1] if stack else _ROOT).base
                if base >= 0 and stack[base].tag == "p":
                    leave(base)
                    in_link = 0
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1].tag == tag:
                leave(len(stack) - 1)
        if tag in VOID:
            continue
        if tag == "a":
            in_link = 1
        names = tuple(n for a in _ATTR.finditer(m[3]) for n in _NAME.findall((a[2] or a[3] or a[4] or "").lower())) if m[3] else ()
        enter(tag, names)
    flush()
    return out


# ---- features ------------------------------------------------------------------------------

DIMENSION = 1 << 12


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSION


@lru_cache(maxsize=200_000)
def _ancestor_slots(inside: frozenset[str], names: frozenset[str], pair: tuple[str, ...], depth: int) -> tuple[int, ...]:
    f = {f"in {t}" for t in inside} | {f"named {n}" for n in names}
    f.add(f"leaf {pair[-1] if pair else '-'}")
    f.add(f"pair {' '.join(pair)}")
    f.add(f"depth {depth}")
    return tuple(sorted({_slot(x) for x in f}))


def features(page: list[Block]) -> list[tuple[int, ...]]:
    """Feature slots of every block of a page."""
    out = []
    for i, b in enumerate(page):
        t, o = b.text, b.place
        low = t.lower()
        n = len(t)
        f = [f"size {min(9, n.bit_length())}", f"links {round(4 * b.linked / n)}",
             f"ends {'.' if t[-1] in '.!?:;…\"' else 'x'}", f"stops {min(4, t.count('. '))}", f"commas {min(3, t.count(','))}",
             f"first {min(i, 3)}", f"last {min(len(page) - 1 - i, 3)}", "any"]
        f += [f"cue {c} {n < 120}" for c in CUES if c in low]
        out.append(tuple(dict.fromkeys(_ancestor_slots(o.inside, o.names, o.pair, min(o.depth, 8)) + tuple(map(_slot, f)))))
    return out


# ---- the model -----------------------------------------------------------------------------

@dataclass
class Chain:
    """Linear-chain CRF with two labels: 0 other, 1 main."""
    emit: np.ndarray                # (DIMENSION, 2)
    move: np.ndarray                # (2, 2), from the label before

    def decode(self, rows: list[tuple[int, ...]]) -> list[int]:
        """Viterbi: the best labelling of one page."""
        if not rows:
            return []
        score = np.array([self.emit[list(r)].sum(axis=0) for r in rows]).tolist()
        (a, b), ((m00, m01), (m10, m11)) = score[0], self.move.tolist()
        back = []
        for e0, e1 in score[1:]:
            p0, p1 = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if p0 else 1, 0 if p1 else 1))
            a, b = (a + m00 if p0 else b + m10) + e0, (a + m01 if p1 else b + m11) + e1
        label = [int(b > a)]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def train(pages: list[list[tuple[int, ...]]], labels: list[list[int]], rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Chain:
    """Maximum likelihood by Adam on exact gradients; all pages step together, short ones masked."""
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels) if p])
    used = sorted({s for p in pages for r in p for s in r})
    number = {s: i for i, s in enumerate(used)}
    width, count = max(map(len, pages)), len(pages)
    x = np.zeros((count, width, len(used)), np.float32)
    y, mask = np.zeros((count, width), int), np.zeros((count, width), bool)
    for i, (p, q) in enumerate(zip(pages, labels)):
        mask[i, :len(p)] = True
        y[i, :len(p)] = q
        for j, r in enumerate(p):
            x[i, j, [number[s] for s in r]] = 1
    flat = x.reshape(-1, len(used))
    one_hot = np.eye(2)[y] * mask[..., None]
    inner = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    seen_moves = (np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :] * inner).sum((0, 1))
    w = [np.zeros((len(used), 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)
    for step in range(1, rounds + 1):
        e = (flat @ w[0]).reshape(count, width, 2)
        fore, rear = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for t in range(1, width):
            fore[:, t] = np.where(mask[:, t, None], e[:, t] + lse(fore[:, t - 1, :, None] + w[1], 1), fore[:, t - 1])
        for t in range(width - 2, -1, -1):
            rear[:, t] = np.where(mask[:, t + 1, None], lse(w[1] + (e[:, t + 1] + rear[:, t + 1])[:, None, :], 2), 0)
        total = lse(fore[:, -1], 1)[:, None, None]
        one = np.exp(np.where(mask[..., None], fore + rear - total, -np.inf))
        two = np.exp(fore[:, :-1, :, None] + w[1] + (e + rear)[:, 1:, None, :] - total[..., None]) * inner
        grads = [flat.T @ (one_hot - one).reshape(-1, 2) / count - decay * w[0], (seen_moves - two.sum((0, 1))) / count - decay * w[1]]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
    emit = np.zeros((DIMENSION, 2))
    emit[used] = w[0]
    return Chain(emit, w[1])


# ---- labelled pages ------------------------------------------------------------------------

def labelled_pages(count: int = 160, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with the label of each block, drawn from a grammar of page parts.

    The parts vary in element (``article``, ``main``, a ``div`` by class, table cells),
    in class names, order, length and noise, so that no single tag decides.
    """
    rnd = random.Random(seed)
    syllables = "ka lo mi ter un sa vel or ni der ast po ruc em il".split()

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def words(lo, hi):
        return " ".join(word() for _ in range(rnd.randint(lo, hi))).capitalize()

    def sentences(lo, hi):
        return " ".join(words(4, 14) + rnd.choice([".", ".", ".", "?", ", " + word() + "."]) for _ in range(rnd.randint(lo, hi)))

    def odd(text):
        return rnd.choice([text] * 6 + [text.replace(" ", " <b>", 1) + "</b>", text.replace(" ", " &amp; ", 1), f"<em>{text}</em>",
                                         re.sub(r" (\w+)", r" \1***", text), text.upper()])

    def named(*names):
        return f' {rnd.choice(["class", "id"])}="{rnd.choice(names)}"'

    def links(lo, hi):
        return [f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rnd.randint(lo, hi))]

    def menu():
        li = links(2, 7)
        return rnd.choice([f"<nav><ul>{''.join(li)}</ul></nav>", f"<div{named('menu', 'navbar', 'nav', 'navigation')}><ul>{''.join(li)}</ul></div>"]), [0] * len(li)

    def top():
        return f"<header{rnd.choice(['', named('site-header', 'top', 'masthead')])}><div>{words(1, 4)}</div><p>{words(2, 6)}</p></header>", [0, 0]

    def advert():
        return f"<{(t := rnd.choice(['div', 'aside', 'section']))}{named('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{sentences(1, 2)}</{t}>", [0]

    def side():
        li = links(1, 4)
        t = rnd.choice(["aside", "div"])
        return f"<{t}{named('sidebar', 'side', 'widget', 'related')}><h3>{words(1, 3)}</h3><ul>{''.join(li)}</ul><p>{sentences(1, 2)}</p></{t}>", [0] * (len(li) + 2)

    def notice():
        return f"<div{named('cookie-notice', 'notice', 'consent', 'alert', 'popup', 'banner')}><p>{rnd.choice(['We use cookies. ', '', 'Please note: '])}{sentences(1, 2)}</p></div>", [0]

    def form():
        return rnd.choice([(f"<form action='/s'><label>{words(1, 2)}</label><input name=q><button>{words(1, 1)}</button></form>", [0, 0]),
                           (f"<div{named('newsletter', 'subscribe', 'search', 'login')}><form><p>{sentences(1, 1)}</p><p>{words(2, 4)}</p></form></div>", [0, 0])])

    def remarks():
        n = rnd.randint(1, 5)
        t = rnd.choice(["div", "section"])
        one = [f"<{'li' if rnd.random() < .4 else 'div'}{named('comment', 'reply')}><p>{sentences(1, 3)}</p>" for _ in range(n)]
        body = "".join(o + ("</li>" if o.startswith("<li") else "</div>") for o in one)
        return f"<{t}{named('comments', 'commentlist', 'discussion', 'responses')}><h3>{words(1, 2)}</h3>{body}</{t}>", [0] * (n + 1)

    def bottom():
        p = f"&copy; {word()}.example.com &middot; {sentences(1, 1)}"
        return rnd.choice([f"<footer>{p}</footer>", f"<footer><p>{p}</p></footer>", f"<div{named('footer', 'site-footer', 'copyright')}><p>{p}</p></div>"]), [0]

    def main():
        body, y = [], []
        if rnd.random() < 0.8:
            title = f"<h1>{odd(words(3, 9))}</h1>"
            body.append(title if rnd.random() < 0.8 else f"<header>{title}</header>")
            y.append(1)
        if rnd.random() < 0.4:
            body.append(f"<p><b>{odd(sentences(1, 1))}<br>")
            y.append(1)
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.72:
                body.append(f"<p>{odd(sentences(1, 6) if rnd.random() < .85 else words(1, 4) + '.')}</p>")
                y.append(1)
            elif kind < 0.8:
                body.append(f"<h2>{odd(words(2, 6))}</h2>")
                y.append(1)
            elif kind < 0.86:
                n = rnd.randint(2, 4)
                body.append("<ul>" + "".join(f"<li>{odd(sentences(1, 1))}</li>" for _ in range(n)) + "</ul>")
                y += [1] * n
            elif kind < 0.9:
                body.append(f"<blockquote>{odd(sentences(1, 3))}</blockquote>")
                y.append(1)
            elif kind < 0.93:
                body.append(f"<div>{odd(sentences(1, 4))}</div>")
                y.append(1)
            else:
                part, q = rnd.choice([advert, notice, form, side])()
                body.append(part)
                y += q
        if rnd.random() < 0.15:
            part, q = remarks()
            body.append(part)
            y += q
        open_, close = rnd.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>")]
                                  + [(f"<div{named('content', 'post', 'entry', 'article', 'story', 'main', 'text', 'body')}>", "</div>")] * 3
                                  + [("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>")])
        return open_ + "".join(body) + close, y

    pages = []
    for _ in range(count):
        before = [p for p in (top, menu, advert, notice, form, side) if rnd.random() < 0.4]
        after = [p for p in (side, advert, remarks, form, notice, menu) if rnd.random() < 0.3] + [bottom] * (rnd.random() < 0.85)
        rnd.shuffle(before)
        parts = [p() for p in before] + [main()] + [p() for p in after]
        head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>"
        page = head + f"<script>var t='<p>';</script><!-- {word()} -->".join(h for h, _ in parts) + rnd.choice(["</body></html>", ""])
        pages.append((page, [q for _, y in parts for q in y]))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Chain:
    """The chain trained on ``labelled_pages`` (a few seconds, on the driver)."""
    pages = [(features(blocks(p)), y) for p, y in labelled_pages()]
    return train([f for f, _ in pages], [y for _, y in pages])


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(features(found))) if keep)


def extracted(page: Column, model: Chain | None = None) -> Column:
    """Main text of an html column (never null)."""
    model = model or default_model()

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py(), model) for v in col], pa.string())
    return run(page)


def extract_pages(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return (pages.select("page_id", "url", extracted(F.col("html"), model).alias("text"))
                 .withColumn("n_chars", F.length("text").cast("long")))
