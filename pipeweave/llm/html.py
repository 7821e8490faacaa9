"""Operator 9: the main text of web pages by two passes of block rules.

A small tokenizer cuts a page into blocks at block-level tags and counts for each its words, stop words
and characters in links, and tells where it stands: in boilerplate (menus, headers, footers, sidebars,
notices, adverts, reader comments, by tag, by role, by class name or id), in an article, in an article
that only announces another one, in a main part, in a form, in a box of related links, or elsewhere.

First pass, in DataFrame expressions: boilerplate is bad. In an article every block is good, linked ones
too, but for forms and boxes of related links that are mostly links; on pages with an article all else is
bad, announcements too, which count as articles only where there is no other. On pages without, the main
part, or else the whole page, is judged by link density, length and stop-word density: good, bad, nearly
good, or too short to tell. Text in forms is bad, unless nothing else is good so: then it is judged like
the rest, as a page may stand in one form. If still nothing is good, as in languages without known stop
words, length and link density decide alone, and if nothing is long, all that is not linked is good.
Second pass: a short block is good if its nearest decided neighbours on both sides are, a nearly
good one if either is; the edges of the page count as bad. The labels of a page are one string, a
character a block, and neighbours are the ends of its runs.

A class name is boilerplate by its head, the last part that is no neutral one such as box, list or a size:
"reader-comments", "google-ad" and "ad-300x250" are, "ad-hoc" and "related-work" are not, nor is what has,
or is laid out with, such a part ("has-sidebar"). Words that are common in prose, such as menu or share,
and ids, which are often made of a headline, count only if all parts are boilerplate or neutral. Names say
nothing on headings and in pre or code. A header that holds an article does not take it away.

White space in a block becomes one blank, blocks are joined by one blank in page order. Work is linear in
the page, however its tags are left open. Rows: one per input row, with its columns but the html, and
text, n_chars; columns of the input that have one of these names, or _blocks or _labels, are replaced.
Null or empty html: empty text. Repeated rows are treated alike; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common short words of the languages of the corpus.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nach nicht sich sie sind und von war wie wir zu zum zur "
    "al como con del el ella en era es esta está fue ha las lo los más muy no o para pero por se ser si sin su sus también un una y ya".split()
)
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S
)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_DROPPED = frozenset("head svg math object canvas select button audio video map datalist dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BAD = frozenset("nav header footer aside form menu fieldset".split())
#: Tags that can change where text stands without a word of their attributes.
_TELLING = _BAD | {"article", "main"}
_FORMS = frozenset("form fieldset".split())
#: Of these, what holds an article all the same is a page in a form or a tag left open, and does not make it boilerplate.
_LOOSE = frozenset("nav header form menu fieldset".split())
_BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Boilerplate where they are the head of a class name, whatever stands before.
_BAD_HEADS = frozenset(
    "ad ads adbox adsbygoogle adslot adunit advert adverts advertisement advertising breadcrumb breadcrumbs comment commentlist comments cookie cookies disqus footer gdpr header login "
    "masthead modal nav navbar newsletter pager pagination popup promo promoted replies sidebar signup sponsored sponsors subscribe toolbar".split()
)
#: Boilerplate where all parts of the name are boilerplate or neutral.
_BAD_WORDS = _BAD_HEADS | frozenset("banner consent menu navigation notice notices promotion rail respond search share sharing side sidebox social sponsor widget widgets".split())
#: Parts that leave the meaning of a name as it is; sizes and digits do too.
_NEUTRAL = frozenset(
    "account alert area author bar block body bottom box btn button buttons column container content copyright count date dialog dropdown form frame global group icon iframe inner item items label "
    "law left legal link links list main message meta mobile outer overlay page panel policy primary privacy reply right secondary section site slot text thread threads title toggle top unit user warning wrap wrapper".split()
)
#: Modifiers of ids: not every word before a boilerplate word, as ids are often headlines.
_MODIFIERS = frozenset("article blog entry google post reader readers visitor visitors".split())
#: In front of a boilerplate word they tell of a page or table that has such a part.
_HAVING = frozenset("cell code col column figure has hide is layout no non not row show table template with without".split())
_SIZE = re.compile(r"\d+(?:x\d+)?(?:px|em|rem)?")
_TEASERS = frozenset("teaser teasers preview excerpt snippet card related recommended".split())
_LINK_BOXES = frozenset("related recommended recommendations more-articles read-more see-also further-reading related-articles related-links related-posts".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open blocks of these tags that the start of a tag ends, when nothing else is open within them.
_CELLS = frozenset("td th".split())
_ENDS = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"},
    "tbody": _CELLS | {"tr", "thead", "tbody"}, "tfoot": _CELLS | {"tr", "thead", "tbody"}, "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
}
#: Where text stands.
HIDDEN, BOILERPLATE, ELSEWHERE, ARTICLE, MAIN, LINKBOX, FORM, TEASER = -2, -1, 0, 1, 2, 3, 4, 5


@lru_cache(maxsize=4096)
def _kind(name: str, slug: bool = False) -> str:
    """What a class name, or an id (slug), says: bad, head, links, teaser or nothing."""
    parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()) if w and not _SIZE.fullmatch(w)]
    if not parts:
        return ""
    head = next((i for i in reversed(range(len(parts))) if parts[i] not in _NEUTRAL), 0)
    whole = any(w in _BAD_WORDS for w in parts) and all(w in _BAD_WORDS or w in _NEUTRAL or (slug and w in _MODIFIERS) for w in parts)
    if whole or (not slug and parts[head] in _BAD_HEADS):
        if _HAVING.intersection(parts[:head]):
            return ""
        return "head" if "header" in parts and not any(w in _BAD_WORDS for w in parts if w != "header") else "bad"
    if "-".join(parts) in _LINK_BOXES:
        return "links"
    return "teaser" if not slug and parts[head] in _TEASERS else ""


def _named(attributes: str) -> str:
    """bad, head, links, teaser or nothing, of a tag's class, id and role."""
    said = set()
    for m in _CLASS.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            said.add("bad" if value.strip().lower() in _BAD_ROLES else "")
        else:
            said.update(_kind(x, m[1].lower() == "id") for x in value.split())
    return next((x for x in ("bad", "head", "links", "teaser") if x in said), "")


class _Frame:
    """An open block with the inline tags that are open in it: (tag, zone)."""

    __slots__ = ("firm", "head", "inline", "name", "open", "zone")

    def __init__(self, name: str, zone: int, firm: bool, head: bool) -> None:
        self.name, self.zone, self.firm, self.head, self.inline, self.open = name, zone, firm, head, [], {}


def blocks_of(page: str) -> Iterator[dict]:
    """text, words, stops, chars, linked (characters) and zone of each block with text."""
    frames, open_, text = [_Frame("", ELSEWHERE, False, False)], {}, []
    linked, links, at, n, zone = 0, 0, 0, len(page), ELSEWHERE

    def flush() -> Iterator[dict]:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            own = words.lower().split(" ")
            yield {"text": words, "words": len(own), "stops": sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in own), "chars": len(words), "linked": min(linked, len(words)), "zone": zone}
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal links
        frame = frames.pop()
        links -= frame.open.get("a", 0)
        open_[frame.name] -= 1

    def pop_inline(frame: _Frame) -> str:
        nonlocal links
        name = frame.inline.pop()[0]
        frame.open[name] -= 1
        links -= name == "a"
        return name

    def add(piece: str) -> None:
        nonlocal linked
        if piece and zone != HIDDEN:
            piece = html.unescape(piece)
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    while at < n:
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in _BLOCKS
        if block:
            if text:
                yield from flush()
        elif name == "br":
            text.append(" ")
        top = frames[-1]
        if m[1]:
            if block and open_.get(name):
                while frames[-1].name != name:
                    pop()
                pop()
            elif not block and top.open.get(name):  # an inline tag ends no block
                while pop_inline(top) != name:
                    pass
        elif name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in _VOID:
            if block:
                if top.name == "p":
                    pop()
                ends = _ENDS.get(name, ())
                while frames[-1].name in ends:
                    pop()
                top = frames[-1]
            elif name == "a" and top.open.get("a"):  # links do not nest
                while pop_inline(top) != "a":
                    pass
            above, firm = top.inline[-1][1] if top.inline else top.zone, top.firm
            named = m[3] and name not in ("html", "body") and name not in _HEADINGS and not (open_.get("pre") or top.open.get("code"))
            said = _named(m[3]) if named else ""
            if above == HIDDEN or name in _DROPPED or (m[3] and _HIDDEN.search(m[3])):
                new = HIDDEN
            elif not m[3] and above >= ELSEWHERE and name not in _TELLING:
                new = above
            elif name == "article":
                if said == "bad" or (above == BOILERPLATE and firm):
                    new, firm = BOILERPLATE, True
                else:
                    announces = said in ("teaser", "links") or above == LINKBOX
                    new, firm = ARTICLE if above == ARTICLE and not announces else TEASER if announces or above == TEASER else ARTICLE, False
            elif above == BOILERPLATE:
                new = ARTICLE if name in _HEADINGS and top.head else BOILERPLATE  # an article's own headline
                firm = firm or said == "bad" or (name in _BAD and name not in _LOOSE)
            elif name in _FORMS and said != "bad" and above not in (ARTICLE, TEASER):
                new = FORM
            elif said in ("bad", "head") or name in _BAD:
                new, firm = BOILERPLATE, said == "bad" or name not in _LOOSE and name in _BAD
            elif above in (ELSEWHERE, FORM) and (name == "main" or (m[3] and "main" in (x[2] or x[3] or x[4] for x in _CLASS.finditer(m[3]) if x[1].lower() == "role"))):
                new = MAIN
            else:
                new = LINKBOX if said == "links" and above not in (ELSEWHERE, FORM) else above
            if block:
                head = new == BOILERPLATE and (top.head if above == BOILERPLATE else above == ARTICLE and (name == "header" or said == "head"))
                frames.append(_Frame(name, new, firm, head and said != "bad" and (name == "header" or name not in _BAD)))
                open_[name] = open_.get(name, 0) + 1
            else:
                top.inline.append((name, new))
                top.open[name] = top.open.get(name, 0) + 1
                links += name == "a"
        now = frames[-1].inline[-1][1] if frames[-1].inline else frames[-1].zone
        if now != zone:
            yield from flush()
            zone = now
    yield from flush()


_KIND = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int32()), ("stops", pa.int32()), ("chars", pa.int32()), ("linked", pa.int32()), ("zone", pa.int8())]))


def _length(b: Column) -> Column:
    """Words, or what the characters would make in words where no blanks part them."""
    return F.greatest(b["words"], F.floor(b["chars"] / 6))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row and not once for each element that body looks at."""
    return F.transform(F.array(value), body)[0]


def _labels(blocks: Column) -> Column:
    """First pass: g good, b bad, n nearly good, s too short to tell."""
    joined = lambda rule: F.array_join(F.transform(blocks, rule), "")
    mostly = lambda b: 2 * b["linked"] > b["chars"]
    in_article = lambda zone: lambda b: F.when(b["zone"] == zone, "g").when((b["zone"] == LINKBOX) & ~mostly(b), "g").otherwise("b")

    def judged(main: Column) -> Column:
        """By rules of blocks, in the main part if there is one."""

        def out_of_place(b: Column, forms: bool) -> Column:
            here = F.when(main, b["zone"] == MAIN).otherwise(b["zone"] == ELSEWHERE) | (b["zone"] == LINKBOX)
            return ~(here | (b["zone"] == FORM) if forms else here) | (3 * b["linked"] > b["chars"])

        def dense(forms: bool):
            def rule(b: Column) -> Column:
                by_stops = F.when(_length(b) >= 30, "g").otherwise("n")
                short = F.when(b["linked"] > 0, "b").otherwise("s")
                return F.when(out_of_place(b, forms), "b").when(_length(b) < 10, short).when(100 * b["stops"] >= 30 * b["words"], by_stops).when(_length(b) >= 20, "n").otherwise("s")

            return rule

        long = lambda forms: lambda b: F.when(out_of_place(b, forms), "b").when(_length(b) >= 10, "g").otherwise("s")
        any_ = lambda forms: lambda b: F.when(out_of_place(b, forms), "b").otherwise("g")
        tries = [joined(rule(forms)) for rule in (dense, long, any_) for forms in (False, True)]

        def first_with_good(rest: list[Column]) -> Column:
            return rest[0] if len(rest) == 1 else _let(rest[0], lambda x: F.when(x.contains("g"), x).otherwise(first_with_good(rest[1:])))

        return first_with_good(tries)

    has = lambda zone: F.exists(blocks, lambda b: b["zone"] == zone)
    return F.when(has(ARTICLE), joined(in_article(ARTICLE))).when(has(TEASER), joined(in_article(TEASER))).otherwise(_let(has(MAIN), judged))


def _decided(labels: Column) -> Column:
    """Second pass: g or b for each block."""

    def settled(runs: Column) -> Column:
        def one(run: Column, i: Column) -> Column:
            before, after = F.coalesce(F.right(F.get(runs, i - 1), F.lit(1)) == "g", F.lit(False)), F.coalesce(F.left(F.get(runs, i + 1), F.lit(1)) == "g", F.lit(False))
            to = F.when(before & after, "gg").when(before | after, "bg").otherwise("bb")
            return F.when(run.rlike("^[sn]"), F.call_function("translate", run, F.lit("sn"), to)).otherwise(run)

        return F.split(F.array_join(F.transform(runs, one), ""), "(?!^)")

    return _let(F.split(labels, r"(?<=[gb])(?=[sn])|(?<=[sn])(?=[gb])"), settled)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (long)."""
    others = [c for c in pages.columns if c not in (source, "text", "n_chars", "_blocks", "_labels")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(blocks_of(x)) if x else [] for x in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            for some in range(0, len(found), 256):
                part = batch.slice(some, 256)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in others], pa.array(found[some : some + 256], _KIND)], [*others, "_blocks"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in others]
    kind = "_blocks array<struct<text:string,words:int,stops:int,chars:int,linked:int,zone:tinyint>>"
    cut_up = pages.select(*others, source).mapInArrow(cut, ", ".join([*fields, kind]))
    kept = _let(_decided(_labels(F.col("_blocks"))), lambda good: F.filter("_blocks", lambda b, i: F.get(good, i) == "g"))
    out = cut_up.withColumn("text", F.array_join(F.transform(kept, lambda x: x["text"]), " "))
    return out.select(*others, "text", F.length("text").cast("long").alias("n_chars"))
