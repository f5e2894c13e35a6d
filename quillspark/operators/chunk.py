"""Chunkers: each turns a text column into an array of chunks, by folds over arrays inside the row.

Nothing is shuffled: a document's chunks come from that document alone. Texts are cut where headers match, so that a part is a
header with what follows it; hierarchies are folds that keep a stack of open headers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import clean_text, emit, fold_out, let, pack, paragraphs, sentences, strip, wide, with_starts
from quillspark.operators import detect as D

CHUNK = "struct<content:string,chunk_id:string,hierarchy:array<string>,start_pos:int,end_pos:int,metadata:map<string,string>>"
# How a section begins, and how clauses do, with their number or letter.
SECTION = wide(r"^\d+(?:\.\d+)*\.\s+[A-Z][^\n]")
CLAUSE_KINDS = {"numeric": wide(r"\((\d+)\)"), "clause": wide(r"Clause\s+(\d+)"), "para": wide(r"Para\.\s+(\d+)"), "letter": r"\(([a-z])\)"}
ARTICLE = "|".join(wide(p).removeprefix("(?i)") for p in D.STATUTE_PATTERNS.values())
#: What ends a section, at the start of a line or of the text that is searched: a number of so many parts, and a capital after it.
ENDING = (wide(r"(?md)^\d+(?:\.\d+){0,"), wide(r"}\.\s+[A-Z]"))
#: A header that begins within so many characters of another doesn't end what stands under that.
SKIP = 10
# The markers that begin a list item, told without case.
MARKERS = tuple(wide(m) for m in (r"\([a-z]\)\s", r"\([ivx]+\)\s", r"\(\d+\)\s", r"[•●○]\s", r"[-*]\s+", r"\d+\.\s", r"[a-z]\.\s"))


@dataclass(frozen=True)
class ChunkOptions:
    """None takes the chunker's own default; given values override it."""

    semantics: str = "observed"
    max_chunk_size: int | None = None
    min_chunk_size: int | None = None
    overlap: int | None = None
    preserve_context: bool = True
    chunk_by_clause: bool = True
    keep_list_context: bool = True
    group_related_items: bool = True
    heading_min_font_ratio: float = 1.2
    use_bold_as_heading: bool = True
    use_centered_as_heading: bool = True
    sentence_overlap: bool = True
    preserve_sentence_integrity: bool = True

    def within(self, most: int, least: int, overlap: int) -> ChunkOptions:
        given = lambda own, other: other if own is None else own
        return replace(self, max_chunk_size=given(self.max_chunk_size, most), min_chunk_size=given(self.min_chunk_size, least), overlap=given(self.overlap, overlap))


def chunk_of(content: Column, chunk_id: Column, hierarchy: Column, start: Column, end: Column, metadata: dict[str, Column]) -> Column:
    entries = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(content.alias("content"), chunk_id.alias("chunk_id"), hierarchy.alias("hierarchy"), start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.create_map(*entries).alias("metadata")).cast(CHUNK)


def _none() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def _texts() -> Column:
    return F.array().cast("array<string>")


def merge_small(chunks: Column, least: int) -> Column:
    """Neighbours that are both below ``least`` become one, with the first's id, hierarchy and start."""
    if not least:
        return chunks

    def add(last: Column, c: Column) -> Column:
        both = last.isNotNull() & (F.length(last["content"]) < least) & (F.length(c["content"]) < least)
        keys = F.map_filter(last["metadata"], lambda k, v: ~F.array_contains(F.map_keys(c["metadata"]), k) & (k != "merged"))
        merged = F.struct(F.concat(last["content"], F.lit("\n\n"), c["content"]).alias("content"), last["chunk_id"].alias("chunk_id"), last["hierarchy"].alias("hierarchy"), last["start_pos"].alias("start_pos"), c["end_pos"].alias("end_pos"), F.map_concat(keys, F.map_filter(c["metadata"], lambda k, v: k != "merged"), F.create_map(F.lit("merged"), F.lit("true"))).alias("metadata"))
        return F.when(both, _step(merged.cast(CHUNK), _none())).when(last.isNull(), _step(c, _none())).otherwise(_step(c, F.array(last)))

    return fold_out(chunks, F.lit(None).cast(CHUNK), add, CHUNK, CHUNK, lambda last: F.filter(F.array(last), lambda c: c.isNotNull()))


def _step(carried: Column, out: Column, kind: str = CHUNK) -> Column:
    return F.struct(carried.alias("carry"), out.alias("out")).cast(f"struct<carry:{kind},out:array<{CHUNK}>>")


def _parts(content: Column, base_id: Column, hierarchy: Column, start: Column, metadata: dict[str, Column], o: ChunkOptions, overlap: int, joint: str = "_part", heading: Column | None = None) -> Column:
    """Chunks of a content that is too long, cut at blank lines."""

    def one(text: Column, i: Column, last: Column) -> Column:
        shown = text if heading is None else F.when(heading.isNull(), text).otherwise(F.concat(heading, F.lit("\n\n"), text))
        partial = (i < last) | (i > 0)
        return chunk_of(strip(shown), F.concat(base_id, F.lit(joint), i.cast("string")), hierarchy, start, start + F.when(i < last, F.length(text)).otherwise(F.length(content)), metadata | {"is_partial": partial, "part_number": i})

    return let(pack(paragraphs(content), o.max_chunk_size, overlap=overlap), lambda texts: F.transform(texts, lambda t, i: one(t, i, F.size(texts) - 1)))


def numbered_chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Sections ``n.``, ``n.m.`` ... with the path of their headers; own contents of at most 50 characters give no chunk."""
    o = options.within(1500, 100, 50)
    return let(with_starts(F.split(clean_text(text, o.semantics), f"(?md)(?={SECTION})")), lambda pieces: _numbered(pieces, o))


def _extended(pieces: Column, i: Column, ends: Callable[[Column], Column]) -> Column:
    """Text of piece i, and where it is shorter than SKIP, of those after it up to the first that ``ends`` it."""
    own = F.get(pieces, i)
    state = "struct<text:string,over:boolean>"

    def add(s: Column, p: Column) -> Column:
        over = s["over"] | ((p["start"] >= own["start"] + SKIP) & ends(p))
        return F.struct(F.when(over, s["text"]).otherwise(F.concat(s["text"], p["text"])).alias("text"), over.alias("over")).cast(state)

    longer = F.reduce(F.slice(pieces, i + 2, F.size(pieces)), F.struct(own["text"].alias("text"), F.lit(False).alias("over")).cast(state), add, lambda s: s["text"])
    return F.when(F.length(own["text"]) >= SKIP, own["text"]).otherwise(longer)


def _up_to_end(text: Column, level: Column) -> Column:
    """A section's text up to the first header of its level or above SKIP characters from its start on. The search begins there, so a
    header just there ends it, in the middle of a line, too; and so does one that is a capital alone, which begins no section."""
    rest = F.substring(text, F.lit(SKIP + 1), F.length(text))
    at = F.regexp_instr(rest, F.concat(F.lit(ENDING[0]), (level - 1).cast("string"), F.lit(ENDING[1])))
    cut = let(at, lambda at: F.when(at > 0, F.left(text, at + (SKIP - 1))).otherwise(text))
    return F.when(rest.rlike(ENDING[0] + ENDING[1]), cut).otherwise(text)


def _numbered(pieces: Column, o: ChunkOptions) -> Column:
    number = lambda p: F.regexp_extract(p["text"], wide(r"^(\d+(?:\.\d+)*)\."), 1)
    title = lambda p: F.regexp_extract(p["text"], wide(r"^\d+(?:\.\d+)*\.\s+([A-Z][^\n]+)"), 1)
    of_number = lambda p, n: F.struct(n.alias("number"), (F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1).alias("level"), title(p).alias("title"), p["text"].alias("text"), p["start"].alias("start"))
    known = F.transform(F.filter(pieces, lambda p: p["text"].rlike(SECTION)), lambda p: let(number(p), lambda n: of_number(p, n)))

    def with_next(known: Column) -> Column:
        text = lambda x, i: let(_extended(known, i, lambda p: p["level"] <= x["level"]), lambda t: _up_to_end(t, x["level"]))
        parent = lambda x, i: F.coalesce(F.get(known, i + 1)["level"] > x["level"], F.lit(False))
        each = lambda x, i: let(parent(x, i), lambda has: F.struct(x["number"].alias("number"), x["level"].alias("level"), x["title"].alias("title"), F.when(has, x["text"]).otherwise(text(x, i)).alias("text"), x["start"].alias("start"), has.alias("parent")))
        return F.transform(known, each)

    opened = "array<struct<level:int,crumb:string,own:string>>"

    def add(open_: Column, x: Column) -> Column:
        p = x["text"]
        own = F.when(x["parent"] & p.rlike(wide(r"\S\n+\S")), strip(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise(strip(p))
        return let(F.struct(own.alias("own"), F.filter(open_, lambda y: y["level"] < x["level"]).alias("outer"), F.concat(x["number"], F.lit(". "), x["title"]).alias("crumb")), lambda k: made(x, k))

    def made(x: Column, k: Column) -> Column:
        own, outer, crumb = k["own"], k["outer"], k["crumb"]
        above = F.coalesce(F.get(outer, F.size(outer) - 1)["own"], F.lit(""))
        path = F.concat(F.filter(F.transform(outer, lambda y: y["crumb"]), lambda c: c.isNotNull()), F.array(crumb))
        content = F.when(F.lit(o.preserve_context) & (above != ""), F.concat(F.lit("[Context: "), F.left(above, F.lit(200)), F.lit("...]\n\n"), own)).otherwise(own)
        root = x["number"] == "0"
        now = F.struct(x["level"].alias("level"), F.when(~root, crumb).alias("crumb"), F.when(~root, F.left(own, F.lit(500))).alias("own"))
        return _step(F.concat(outer, F.array(now)).cast(opened), F.when((F.length(own) <= 50) | root, _none()).otherwise(let(content, lambda c: chunks(x, c, path))), opened)

    def chunks(x: Column, content: Column, path: Column) -> Column:
        ident, kind = F.concat(F.lit("section_"), F.replace(x["number"], F.lit("."), F.lit("_"))), {"type": F.lit("numbered_section")}
        end = x["start"] + F.length(x["text"])
        whole = F.array(chunk_of(content, ident, path, x["start"], end, kind | {"section_number": x["number"], "section_title": x["title"], "level": x["level"]}))
        return F.when(F.length(content) > o.max_chunk_size, _parts(content, ident, path, x["start"], kind, o, o.overlap)).otherwise(whole)

    folded = let(let(known, with_next), lambda sections: fold_out(sections, F.array().cast(opened), add, opened, CHUNK, lambda _: _none()))
    return merge_small(folded, o.min_chunk_size)


def statute_chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Articles and sections, by clause where they have clauses; what stands before the first article is dropped."""
    o = options.within(1200, 100, 30)
    return let(with_starts(F.split(clean_text(text, o.semantics), f"(?i)(?={ARTICLE})")), lambda pieces: _statute(pieces, o))


def _statute(pieces: Column, o: ChunkOptions) -> Column:
    any_of = lambda *kinds: "|".join(CLAUSE_KINDS[k].replace("(", "(?:").replace("\\(?:", "\\(") for k in kinds)

    def clauses(p: Column, counts: Column, start: Column, number: Column, title: Column, path: Column) -> Column:
        cut = lambda *kinds: F.split(p, f"(?={any_of(*kinds)})")
        marked = F.when(counts["numeric"] >= 3, cut("numeric")).when(counts["clause"] + counts["para"] > 0, cut("clause", "para")).otherwise(cut(*CLAUSE_KINDS))
        return let(with_starts(marked), lambda cuts: let(strip(F.get(cuts, F.lit(0))["text"]), lambda preamble: F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), lambda c: one(c, preamble, start, number, title, path))))

    def one(cut: Column, preamble: Column, start: Column, number: Column, title: Column, path: Column) -> Column:
        piece, of = cut["text"], F.lit("letter")
        for k in ("para", "clause", "numeric"):
            of = F.when(piece.rlike(f"^(?:{CLAUSE_KINDS[k]})"), k).otherwise(of)
        ident = F.coalesce(*[F.nullif(F.regexp_extract(piece, f"^{pattern}", 1), F.lit("")) for pattern in CLAUSE_KINDS.values()])
        body = strip(piece)
        content = F.when(F.lit(o.preserve_context) & (preamble != ""), F.concat(F.lit("[Article Context: "), F.left(preamble, F.lit(200)), F.lit("...]\n\n"), body)).otherwise(body)
        at = start + cut["start"]
        return let(ident, lambda ident: chunk_of(content, F.concat(F.lit("article_"), number, F.lit("_clause_"), ident), F.concat(path, F.array(F.concat(F.lit("Clause "), ident))), at, at + F.length(piece), {"type": F.lit("statute_clause"), "article_number": number, "article_title": title, "clause_id": ident, "clause_type": of}))

    def article(pieces: Column, i: Column) -> Column:
        own = F.get(pieces, i)
        marker = F.regexp_extract(own["text"], f"(?i)^(?:{ARTICLE})", 0)
        # A title is looked for in 200 characters, which a hundred pieces hold, since a marker has two at least.
        beyond = F.array_join(F.transform(_between(pieces, i, F.least(i + 102, F.size(pieces))), lambda p: p["text"]), "")
        title = lambda m: F.regexp_extract(F.substring(F.when(F.length(own["text"]) >= F.length(m) + 200, own["text"]).otherwise(beyond), F.length(m) + 1, F.lit(200)), wide(r"[:\-]?\s*([A-Z][^\n]+)"), 1)
        about = lambda m: F.struct(F.regexp_extract(m, wide(r"\d+"), 0).alias("number"), F.when(m.rlike("(?i)^art"), "Article").otherwise("Section").alias("kind"), title(m).alias("title"), _extended(pieces, i, lambda p: F.lit(True)).alias("text"), own["start"].alias("start"))
        return let(let(marker, about), lambda a: let(F.struct(*[F.regexp_count(a["text"], F.lit(p)).alias(k) for k, p in CLAUSE_KINDS.items()]), lambda counts: of(a, counts)))

    def of(a: Column, counts: Column) -> Column:
        p, start, number, title = a["text"], a["start"], a["number"], a["title"]
        path = F.array(F.concat(a["kind"], F.lit(" "), number, F.lit(": "), title))
        about, ident = {"type": F.lit("statute_article"), "article_number": number, "article_title": title}, F.concat(F.lit("article_"), number)
        whole = F.when(F.length(p) <= o.max_chunk_size, F.array(chunk_of(p, ident, path, start, start + F.length(p), about))).otherwise(_parts(p, ident, path, start, about, o, o.overlap))
        has = counts["numeric"] + counts["clause"] + counts["para"] + counts["letter"] > 0
        return F.when(F.lit(o.chunk_by_clause) & has, clauses(p, counts, start, number, title, path)).otherwise(whole)

    marked = F.filter(pieces, lambda p: p["text"].rlike(f"(?i)^(?:{ARTICLE})"))
    return merge_small(F.flatten(let(marked, lambda known: F.transform(known, lambda _, i: article(known, i)))), o.min_chunk_size)


def _is_heading(line: Column) -> Column:
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    return (F.length(line) <= 100) & (upper | (F.regexp_count(line, F.lit(r"\p{Lu}")) / F.greatest(F.length(line), F.lit(1)) > 0.7) | line.rlike(wide(r"^\d+\.?\d*\s+[A-Z]")))


def _marker(line: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, f"(?i)^{m}", 0), F.lit("")) for m in MARKERS])


def _marker_type(m: Column) -> Column:
    return F.when(m.rlike(r"^\([a-z]\)"), "letter").when(m.rlike(r"^\([ivx]+\)"), "roman").when(m.rlike(wide(r"^\(\d+\)")), "number").when(m.rlike("^[•●○]"), "bullet").otherwise("other")


def _between(items: Column, first: Column, end: Column) -> Column:
    """Items from ``first`` up to ``end``, at the cost of those alone; to slice an array costs all of it."""
    return F.when(end > first, F.transform(F.sequence(first, end - 1), lambda j: F.get(items, j))).otherwise(F.slice(items, F.lit(1), F.lit(0)))


_ITEM = "struct<marker:string,content:string,line:int>"
_LINE = "struct<line:string,at:int,marker:string>"


def policy_blocks(text: Column, semantics: str = "observed") -> Column:
    """Blocks of a heading, paragraph lines and list items. A line after an item that begins none belongs to that item; a
    heading with nothing below is dropped."""
    return let(F.split(clean_text(text, semantics), "\n"), _blocks)


def _blocks(lines: Column) -> Column:
    told = F.transform(lines, lambda l, i: let(_is_heading(l), lambda head: F.struct(l.alias("line"), i.alias("at"), head.alias("head"), F.when(~head, _marker(l)).alias("marker"))))
    told = F.filter(told, lambda x: x["line"] != "")
    span = "struct<heading:string,line:int,first:int,last:int>"
    begun = "struct<heading:string,line:int,first:int>"

    def spans(told: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            done = F.struct(s["heading"].alias("heading"), s["line"].alias("line"), s["first"].alias("first"), x["i"].alias("last")).cast(span)
            new = F.struct(x["line"].alias("heading"), x["at"].alias("line"), (x["i"] + 1).alias("first")).cast(begun)
            return F.struct(new.alias("carry"), F.array(done).alias("out"))

        heads = F.filter(F.transform(told, lambda x, i: F.struct(x["line"].alias("line"), x["at"].alias("at"), x["head"].alias("head"), i.alias("i"))), lambda x: x["head"])
        zero = F.struct(F.lit(None).cast("string").alias("heading"), F.lit(0).alias("line"), F.lit(0).alias("first")).cast(begun)
        end = lambda s: F.array(F.struct(s["heading"].alias("heading"), s["line"].alias("line"), s["first"].alias("first"), F.size(told).alias("last")).cast(span))
        return F.filter(fold_out(heads, zero, add, begun, span, end), lambda s: s["last"] > s["first"])

    def block(told: Column, s: Column) -> Column:
        body = _between(told, s["first"], s["last"])
        return let(body, lambda body: let(F.filter(F.transform(body, lambda x, i: F.when(x["marker"].isNotNull(), i)), lambda i: i.isNotNull()), lambda starts: filled(s, body, starts)))

    def filled(s: Column, body: Column, starts: Column) -> Column:
        before = F.coalesce(F.get(starts, F.lit(0)), F.size(body))

        def item(i: Column, j: Column) -> Column:
            x, after = F.get(body, i), F.coalesce(F.get(starts, j + 1), F.size(body))
            own = strip(F.substring(x["line"], F.length(x["marker"]) + 1, F.length(x["line"])))
            more = F.transform(_between(body, i + 1, after), lambda y: y["line"])
            return F.struct(x["marker"].alias("marker"), F.array_join(F.concat(F.array(own), more), " ").alias("content"), x["at"].alias("line")).cast(_ITEM)

        return F.struct(s["heading"].alias("heading"), F.transform(F.slice(body, F.lit(1), before), lambda x: x["line"]).alias("paragraph"), F.transform(starts, item).alias("items"), s["line"].alias("line"))

    return let(told, lambda told: F.transform(spans(told), lambda s: block(told, s)))


def policy_chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Blocks whole where they fit, else their list items in groups of one marker type. Positions are line numbers."""
    o = options.within(1000, 100, 0)
    shown = lambda items: F.array_join(F.transform(items, lambda x: F.concat(x["marker"], x["content"])), "\n")

    def groups(items: Column) -> Column:
        carry = f"struct<group:array<{_ITEM}>,size:int>"

        def add(s: Column, x: Column) -> Column:
            last, size = F.get(s["group"], F.size(s["group"]) - 1), F.length(x["content"])
            apart = (_marker_type(x["marker"]) != _marker_type(last["marker"])) | (s["size"] + size > o.max_chunk_size * 0.8)
            new = F.struct(F.array(x).alias("group"), size.alias("size")).cast(carry)
            grown = F.struct(F.concat(s["group"], F.array(x)).alias("group"), (s["size"] + size).alias("size")).cast(carry)
            give = lambda carried, *out: F.struct(carried.alias("carry"), F.array(*out).cast(f"array<array<{_ITEM}>>").alias("out"))
            return F.when(F.size(s["group"]) == 0, give(new)).when(apart, give(new, s["group"])).otherwise(give(grown))

        zero = F.struct(F.array().cast(f"array<{_ITEM}>").alias("group"), F.lit(0).alias("size"))
        return fold_out(items, zero, add, carry, f"array<{_ITEM}>", lambda s: F.filter(F.array(s["group"]), lambda g: F.size(g) > 0))

    def block(b: Column, i: Column) -> Column:
        heading, items, para = b["heading"], b["items"], F.array_join(b["paragraph"], " ")
        has, path = heading.isNotNull(), F.when(heading.isNotNull(), F.array(heading)).otherwise(_texts())
        full = F.concat(F.when(has, F.concat(heading, F.lit("\n"))).otherwise(""), para, F.when((para != "") & (F.size(items) > 0), "\n\n").otherwise(""), shown(items))
        base, index = F.concat(F.lit("block_"), i.cast("string")), {"block_index": i}
        whole = F.array(chunk_of(full, base, path, b["line"], b["line"] + F.length(full), index | {"type": F.lit("policy_block"), "has_heading": has, "list_item_count": F.size(items)}))

        def group(g: Column, j: Column) -> Column:
            context = F.when((j == 0) & F.lit(o.keep_list_context) & (para != ""), F.concat(para, F.lit("\n\n"))).otherwise("")
            content = F.concat(F.when(has, F.concat(heading, F.lit("\n\n"))).otherwise(""), context, shown(g))
            first, last = F.element_at(g, 1), F.element_at(g, -1)
            return chunk_of(content, F.concat(base, F.lit("_group_"), j.cast("string")), F.concat(path, F.array(F.concat(F.lit("Items "), first["marker"], F.lit("-"), last["marker"]))), first["line"], last["line"], index | {"type": F.lit("policy_list_group"), "group_index": j, "list_item_count": F.size(g)})

        grouped = F.lit(o.group_related_items) & (F.size(items) > 0)
        return F.when(F.length(full) <= o.max_chunk_size, whole).when(grouped, F.transform(groups(items), group)).otherwise(_parts(full, base, path, F.lit(0), index | {"type": F.lit("policy_block")}, o, 0, "_part_"))

    return merge_small(F.flatten(F.transform(policy_blocks(text, o.semantics), block)), o.min_chunk_size)


def layout_chunks(text: Column, layout: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Sections under headings that the layout shows by font, weight or place. Without headings the text is one section; without
    blocks it is cut at blank lines."""
    o = options.within(1500, 100, 0)
    return let(clean_text(text, o.semantics), lambda clean: let(F.regexp_replace(clean, wide(r"\s+"), " "), lambda flat: _layout(clean, flat, layout, o)))


def _layout(clean: Column, flat: Column, layout: Column, o: ChunkOptions) -> Column:
    base = F.coalesce(layout["base_font_size"], F.lit(10.0))
    size = lambda b: F.coalesce(b["font_size"], base)
    shown = lambda b: strip(F.coalesce(b["text"], F.lit("")))
    is_head = lambda b: F.length(shown(b)).between(1, 200) & ((size(b) >= base * o.heading_min_font_ratio) | (F.lit(o.use_bold_as_heading) & F.coalesce(b["is_bold"], F.lit(False))) | (F.lit(o.use_centered_as_heading) & F.coalesce(b["is_centered"], F.lit(False))))
    level = lambda b: F.when(size(b) >= base * 1.5, 1).when((size(b) >= base * 1.3) & (size(b) >= base * o.heading_min_font_ratio), 2).otherwise(3)
    place = lambda b: F.instr(flat, F.regexp_replace(shown(b), wide(r"\s+"), " ")) - 1
    fields = {"text": "string", "font_size": "double", "is_bold": "boolean", "is_centered": "boolean"}
    known = F.transform(layout["blocks"], lambda b: F.struct(*[b[f].cast(t).alias(f) for f, t in fields.items()]))  # blocks may have more fields
    blocks = F.coalesce(known, F.array().cast(f"array<struct<{','.join(f'{f}:{t}' for f, t in fields.items())}>>"))
    found = F.filter(F.transform(F.filter(blocks, is_head), lambda b: F.struct(place(b).alias("at"), shown(b).alias("text"), level(b).alias("level"))), lambda h: h["at"] >= 0)
    return let(F.array_sort(F.transform(found, lambda h, i: F.struct(h["at"].alias("at"), i.alias("i"), h["text"].alias("text"), h["level"].alias("level")))), lambda heads: _under(heads, clean, blocks, o))


def _under(heads: Column, clean: Column, blocks: Column, o: ChunkOptions) -> Column:
    opened = "array<struct<level:int,text:string>>"

    def add(open_: Column, i: Column) -> Column:
        h, after = F.get(heads, i), F.get(heads, i + 1)
        end = F.coalesce(after["at"], F.length(clean))
        content = strip(F.substring(clean, h["at"] + F.length(h["text"]) + 1, F.greatest(end - h["at"] - F.length(h["text"]), F.lit(0))))
        outer = F.filter(open_, lambda x: x["level"] < h["level"])
        path = F.concat(F.transform(outer, lambda x: x["text"]), F.array(h["text"]))
        ident, about = F.concat(F.lit("section_"), i.cast("string")), {"type": F.lit("layout_section"), "section_index": i, "heading": h["text"]}
        made = lambda content: F.when(F.length(content) <= o.max_chunk_size, F.array(chunk_of(content, ident, path, h["at"], end, about | {"level": h["level"]}))).otherwise(_parts(content, ident, path, h["at"], about, o, 0, "_part_", h["text"]))
        return _step(F.concat(outer, F.array(F.struct(h["level"].alias("level"), h["text"].alias("text")))).cast(opened), let(content, made), opened)

    places = F.filter(F.sequence(F.lit(0), F.size(heads)), lambda i: i < F.size(heads))
    sections = fold_out(places, F.array().cast(opened), add, opened, CHUNK, lambda _: _none())
    one = F.array(chunk_of(clean, F.lit("section_0"), _texts(), F.lit(0), F.length(clean), {"type": F.lit("layout_section"), "section_index": F.lit(0), "level": F.lit(0)}))
    plain = F.transform(pack(paragraphs(clean), o.max_chunk_size), lambda t, i: chunk_of(t, F.concat(F.lit("fallback_"), i.cast("string")), _texts(), F.lit(0), F.length(t), {"type": F.lit("layout_fallback")}))
    whole = F.when(F.length(clean) <= o.max_chunk_size, one).otherwise(plain)
    return merge_small(F.when(F.size(blocks) == 0, plain).when(F.size(heads) == 0, whole).otherwise(sections), o.min_chunk_size)


def last_sentences(text: Column, most: int, semantics: str) -> Column:
    """The longest run of whole sentences at the end within ``most`` characters, spaces not counted; empty if the last is longer."""
    zero = F.struct(_texts().alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("over"))

    def add(s: Column, x: Column) -> Column:
        over = s["over"] | (s["size"] + F.length(x) > most)
        return F.struct(F.when(over, s["kept"]).otherwise(F.concat(F.array(x), s["kept"])).alias("kept"), F.when(over, s["size"]).otherwise(s["size"] + F.length(x)).alias("size"), over.alias("over"))

    return F.reduce(F.reverse(sentences(text, semantics)), zero, add, lambda s: F.array_join(s["kept"], " "))


def paragraph_chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Paragraphs packed up to a size; longer ones cut at sentences, or at a fixed width; each but the first is preceded by the
    last sentences of the one before. An empty text has no chunks."""
    o = options.within(1000, 200, 100)
    return let(clean_text(text, o.semantics), lambda clean: _paragraph(clean, o))


def _paragraph(clean: Column, o: ChunkOptions) -> Column:
    about = {"type": F.lit("paragraph"), "is_fallback": F.lit(True)}
    base = F.transform(pack(paragraphs(clean, wide(r"\n\s*\n+")), o.max_chunk_size, count_joiners=False), lambda t, i: chunk_of(t, F.concat(F.lit("para_"), i.cast("string")), _texts(), F.greatest(F.instr(clean, F.left(t, F.lit(80))) - 1, F.lit(0)), F.greatest(F.instr(clean, F.left(t, F.lit(80))) - 1, F.lit(0)) + F.length(t), about))

    def split(c: Column) -> Column:
        if o.preserve_sentence_integrity:
            texts = pack(sentences(c["content"], o.semantics), o.max_chunk_size, " ")
        else:
            texts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(c["content"]) / o.max_chunk_size).cast("int") - 1), lambda i: F.substring(c["content"], i * o.max_chunk_size + 1, F.lit(o.max_chunk_size)))
        return let(texts, lambda known: parts_of(c, known))

    def parts_of(c: Column, texts: Column) -> Column:
        last, fixed = F.size(texts) - 1, not o.preserve_sentence_integrity
        start = lambda i: c["start_pos"] + (i * o.max_chunk_size if fixed else 0)
        end = lambda t, i: start(i) + o.max_chunk_size if fixed else F.when(i < last, c["start_pos"] + F.length(t)).otherwise(c["end_pos"])
        return F.transform(texts, lambda t, i: chunk_of(t if fixed else strip(t), F.concat(c["chunk_id"], F.lit("_part"), i.cast("string")), c["hierarchy"], start(i), end(t, i), about | {"is_partial": F.lit(True) if fixed else (last > 0) & ((i < last) | (i > 0)), "part_number": i}))

    chunks = F.flatten(F.transform(base, lambda c: F.when(F.length(c["content"]) > o.max_chunk_size, split(c)).otherwise(F.array(c))))
    if not o.sentence_overlap:
        return chunks

    def lead(chunks: Column, c: Column, i: Column) -> Column:
        before = last_sentences(F.get(chunks, i - 1)["content"], o.overlap, o.semantics)
        content = F.when(i > 0, F.concat(F.lit("[..."), before, F.lit("]\n\n"), c["content"])).otherwise(c["content"])
        return F.struct(content.alias("content"), c["chunk_id"].alias("chunk_id"), c["hierarchy"].alias("hierarchy"), c["start_pos"].alias("start_pos"), c["end_pos"].alias("end_pos"), F.map_concat(c["metadata"], F.create_map(F.lit("has_overlap"), (i > 0).cast("string"))).alias("metadata")).cast(CHUNK)

    return let(chunks, lambda known: F.when(F.size(known) > 1, F.transform(known, lambda c, i: lead(known, c, i))).otherwise(known))


@dataclass
class Chunkers:
    """Which function cuts which kind of document; further kinds can be registered."""

    by_type: dict[str, Callable[..., Column]] = field(default_factory=lambda: {D.NUMBERED: numbered_chunks, D.STATUTE: statute_chunks, D.POLICY: policy_chunks, D.UNSTRUCTURED: paragraph_chunks})

    def register(self, doc_type: str, chunker: Callable[..., Column]) -> None:
        self.by_type[doc_type] = chunker

    def get(self, doc_type: str) -> Callable[..., Column]:
        if doc_type not in self.by_type:
            raise ValueError(f"no chunker for {doc_type!r}; there are {sorted(self.by_type)}")
        return self.by_type[doc_type]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout_col: str | None = None, options: ChunkOptions = ChunkOptions(), detect_options: D.DetectOptions = D.DetectOptions(), chunkers: Chunkers | None = None) -> DataFrame:
    """One row a chunk: ``id_col``, doc_type, ordinal (from 0) and the chunk's fields. Documents without chunks give no row."""
    found = with_chunks(docs, text_col, layout_col, options, detect_options, chunkers)
    # An inner explode would be given a filter on the size of its array below the projection, and so cut each text once more for it.
    one = found.select(F.col(id_col), F.col("__type").alias("doc_type"), F.posexplode_outer("__chunks").alias("ordinal", "chunk"))
    return one.where(F.col("ordinal").isNotNull()).select(id_col, "doc_type", "ordinal", "chunk.*")


@lru_cache(maxsize=16)
def _chunks_of(text_col: str, layout_col: str | None, options: ChunkOptions, kinds: tuple) -> Column:
    """The chunks by __type. Building the expression takes longer than cutting a small table, so it is kept."""
    text, chunks = F.coalesce(F.col(text_col), F.lit("")), F.lit(None).cast(f"array<{CHUNK}>")
    if layout_col and D.LAYOUT not in dict(kinds):
        kinds = (*kinds, (D.LAYOUT, lambda t, o: layout_chunks(t, F.col(layout_col), o)))
    for kind, chunker in kinds:
        chunks = F.when(F.col("__type") == kind, chunker(text, options)).otherwise(chunks)
    return chunks


def with_chunks(docs: DataFrame, text_col: str, layout_col: str | None, options: ChunkOptions, detect_options: D.DetectOptions, chunkers: Chunkers | None) -> DataFrame:
    """``docs`` with __type and __chunks. One scan; a fold runs only for the documents of its kind."""
    kinds = tuple((chunkers or Chunkers()).by_type.items())
    chunks = _chunks_of(text_col, layout_col, options, kinds)
    return docs.withColumn("__type", D.kind_of(F.col(text_col), layout_col, detect_options)).withColumn("__chunks", chunks)


def chunk_batch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout_col: str | None = None, options: ChunkOptions = ChunkOptions(), detect_options: D.DetectOptions = D.DetectOptions(), chunkers: Chunkers | None = None, also: list[str] | None = None) -> DataFrame:
    """One row a document, those without chunks too: ``id_col``, doc_type, chunks (an array), error and warning, which say why there
    are none: no text, no chunker for its kind, or no part that is long enough for a chunk; and the columns ``also``."""
    found = with_chunks(docs, text_col, layout_col, options, detect_options, chunkers)
    error = F.when(F.col(text_col).isNull(), "no text").when(F.col("__chunks").isNull(), F.concat(F.lit("no chunker for "), F.col("__type")))
    warning = F.when(F.col(text_col).isNotNull() & (F.size("__chunks") == 0), "no part is long enough for a chunk")
    return found.select(F.col(id_col), F.col("__type").alias("doc_type"), F.coalesce("__chunks", _none()).alias("chunks"), error.alias("error"), warning.alias("warning"), *(also or []))
