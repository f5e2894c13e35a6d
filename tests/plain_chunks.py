"""The chunkers as loops over one text, by which the library's are tested."""

import re

# The patterns by which documents are cut, and the words that tell their parts.
ENDING = re.compile(r"^(\d+(?:\.\d+)*)\.\s+[A-Z]", re.M)
SECTION = re.compile(r"^(\d+(?:\.\d+)*)\.\s+([A-Z][^\n]+)", re.M)
ARTICLE = re.compile(r"Article\s+\d+|Art\.\s+\d+|Section\s+\d+|§\s*\d+", re.I)
CLAUSES = {"numeric": r"\((\d+)\)", "clause": r"Clause\s+(\d+)", "para": r"Para\.\s+(\d+)", "letter": r"\(([a-z])\)"}
MARKERS = [r"\([a-z]\)\s", r"\([ivx]+\)\s", r"\(\d+\)\s", r"[•●○]\s", r"[-*]\s+", r"\d+\.\s", r"[a-z]\.\s"]


def kind_of(text):
    # The patterns of the kinds.
    n = sum(len(re.findall(p, text)) for p in (r"\n\d+\.\s+[A-Z][A-Z\s]{2,}", r"\n\d+\.\d+\s+[A-Z]", r"(?m)^\d+\.\s+[A-Z][A-Z\s]{2,}"))
    if n >= 3:
        return "numbered_sections"
    if sum(len(re.findall(p, text, re.I)) for p in (r"Article\s+\d+", r"Art\.\s+\d+", r"Section\s+\d+", r"§\s*\d+")) >= 2:
        return "statute"
    listed = sum(len(re.findall(p, text)) for p in (r"\([a-z]\)", r"\([ivx]+\)", r"\n\s*[•●○]\s", r"\n\s*-\s+[A-Z]"))
    return "policy_or_terms" if listed >= 5 else "unstructured"


def clean(text, mode):
    lines = [x.strip() for x in text.split("\n")]
    return "\n".join(x for x in lines if x) if mode == "observed" else re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def sentences(text, mode):
    return [text.strip()] if mode == "observed" else [x.strip() for x in re.sub(r"([.!?][\"'»]?)\s+(?=[A-Z])", "\\1\0", text).split("\0")]


def paragraphs(text, pattern="\n\n"):
    return [p for x in re.split(pattern, text) if (p := x.strip())]


def pack(parts, most, joiner="\n\n", overlap=0, count_joiners=True):
    out, now, size = [], "", 0
    for p in parts:
        if now and size + len(p) > most:
            out.append(now)
            now = now[-overlap:] + joiner + p if overlap else p
            size = len(now) if count_joiners else len(p)
        else:
            now = now + joiner + p if now else p
            size = len(now) if count_joiners else size + len(p)
    return out + [now] * bool(now)


def chunk(content, ident, path, start, end):
    return [content, ident, path, start, end]


def parts(content, ident, path, start, most, overlap, joint="_part"):
    texts = pack(paragraphs(content), most, overlap=overlap)
    return [chunk(t.strip(), f"{ident}{joint}{i}", path, start, start + len(t if i < len(texts) - 1 else content)) for i, t in enumerate(texts)]


def merged(chunks, least):
    out = []
    for c in chunks:
        if out and len(out[-1][0]) < least and len(c[0]) < least:
            last = out[-1]
            out[-1] = chunk(last[0] + "\n\n" + c[0], last[1], last[2], last[3], c[4])
        else:
            out.append(c)
    return out


def numbered(text, mode, most=1500, least=100, overlap=50):
    text, out, stack = clean(text, mode), [], []
    heads = [(m.start(), m[1], m[2], m[1].count(".") + 1) for m in SECTION.finditer(text)]
    for i, (start, number, title, level) in enumerate(heads):
        child = i + 1 < len(heads) and heads[i + 1][3] > level
        end = heads[i + 1][0] if child else next((start + 10 + m.start() for m in ENDING.finditer(text[start + 10 :]) if m[1].count(".") < level), len(text))
        body = text[start:end]
        own = body.split("\n", 1)[1].strip() if child and "\n" in body.strip() else body.strip()
        stack = [s for s in stack if s[0] < level]
        above = stack[-1][2] if stack else ""
        path = [s[1] for s in stack if s[1]] + [f"{number}. {title}"]
        content = f"[Context: {above[:200]}...]\n\n{own}" if above else own
        root = number == "0"
        stack.append((level, None if root else path[-1], "" if root else own[:500]))
        if len(own) > 50 and not root:
            ident = "section_" + number.replace(".", "_")
            out += parts(content, ident, path, start, most, overlap) if len(content) > most else [chunk(content, ident, path, start, start + len(body))]
    return merged(out, least)


def statute(text, mode, most=1200, least=100, overlap=30):
    text, out = clean(text, mode), []
    heads = [(m.start(), m[0]) for m in ARTICLE.finditer(text)]
    for i, (start, mark) in enumerate(heads):
        end = next((s for s, _ in heads[i + 1 :] if s >= start + 10), len(text))
        body, number = text[start:end], re.search(r"\d+", mark)[0]
        title = m[1] if (m := re.search(r"[:\-]?\s*([A-Z][^\n]+)", text[start + len(mark) : start + len(mark) + 200])) else ""
        path = [f"{'Article' if mark.lower().startswith('art') else 'Section'} {number}: {title}"]
        found = sorted((m.start(), k, m[1]) for k, p in CLAUSES.items() for m in re.finditer(p, body))
        if sum(k == "numeric" for _, k, _ in found) >= 3:
            found = [f for f in found if f[1] == "numeric"]
        elif any(k in ("clause", "para") for _, k, _ in found):
            found = [f for f in found if f[1] in ("clause", "para")]
        if found:
            lead = body[: found[0][0]].strip()
            for j, (at, _, name) in enumerate(found):
                piece = body[at : found[j + 1][0] if j + 1 < len(found) else len(body)]
                content = f"[Article Context: {lead[:200]}...]\n\n{piece.strip()}" if lead else piece.strip()
                out.append(chunk(content, f"article_{number}_clause_{name}", [*path, f"Clause {name}"], start + at, start + at + len(piece)))
        elif len(body) <= most:
            out.append(chunk(body, f"article_{number}", path, start, start + len(body)))
        else:
            out += parts(body, f"article_{number}", path, start, most, overlap)
    return merged(out, least)


def is_heading(line):
    return len(line) <= 100 and (line.isupper() or sum(c.isupper() for c in line) / max(len(line), 1) > 0.7 or bool(re.match(r"\d+\.?\d*\s+[A-Z]", line)))


def marker_kind(marker):
    for name, p in (("letter", r"\([a-z]\)"), ("roman", r"\([ivx]+\)"), ("number", r"\(\d+\)"), ("bullet", "[•●○]")):
        if re.match(p, marker):
            return name
    return "other"


def policy(text, mode, most=1000, least=100):
    blocks, now = [], (None, [], [], 0)
    for i, line in enumerate(clean(text, mode).split("\n")):
        if not line:
            continue
        if is_heading(line):
            blocks.append(now)
            now = (line, [], [], i)
        elif m := next((m for p in MARKERS if (m := re.match(p, line, re.I))), None):
            now[2].append([m[0], line[m.end() :].strip(), i])
        elif now[2]:
            now[2][-1][1] += " " + line
        else:
            now[1].append(line)
    blocks = [b for b in [*blocks, now] if b[1] or b[2]]
    out = []
    for i, (heading, lines, items, line) in enumerate(blocks):
        para, path = " ".join(lines), [heading] if heading is not None else []
        shown = lambda xs: "\n".join(m + c for m, c, _ in xs)
        full = (f"{heading}\n" if path else "") + para + ("\n\n" if para and items else "") + shown(items)
        if len(full) <= most:
            out.append(chunk(full, f"block_{i}", path, line, line + len(full)))
        elif items:
            groups, size = [], 0
            for x in items:
                if not groups or marker_kind(x[0]) != marker_kind(groups[-1][-1][0]) or size + len(x[1]) > most * 0.8:
                    groups.append([])
                    size = 0
                groups[-1].append(x)
                size += len(x[1])
            for j, g in enumerate(groups):
                content = (f"{heading}\n\n" if path else "") + (para + "\n\n" if j == 0 and para else "") + shown(g)
                out.append(chunk(content, f"block_{i}_group_{j}", [*path, f"Items {g[0][0]}-{g[-1][0]}"], g[0][2], g[-1][2]))
        else:
            out += parts(full, f"block_{i}", path, 0, most, 0, "_part_")
    return merged(out, least)


def paragraph(text, mode, most=1000, overlap=100):
    text, out = clean(text, mode), []
    for i, t in enumerate(pack(paragraphs(text, r"\n\s*\n+"), most, count_joiners=False)):
        at = max(text.find(t[:80]), 0)
        if len(t) <= most:
            out.append(chunk(t, f"para_{i}", [], at, at + len(t)))
            continue
        texts = pack(sentences(t, mode), most, " ")
        out += [chunk(x.strip(), f"para_{i}_part{j}", [], at, at + len(x if j < len(texts) - 1 else t)) for j, x in enumerate(texts)]
    if len(out) < 2:
        return out
    led = [out[0]]
    for before, c in zip(out, out[1:], strict=False):
        tail, size = [], 0
        for x in reversed(sentences(before[0], mode)):
            if size + len(x) > overlap:
                break
            tail.insert(0, x)
            size += len(x)
        led.append(chunk(f"[...{' '.join(tail)}]\n\n{c[0]}", *c[1:]))
    return led


CHUNKERS = {"numbered_sections": numbered, "statute": statute, "policy_or_terms": policy, "unstructured": paragraph}


def chunks(text, mode="observed", **options):
    return CHUNKERS[kind_of(text)](text, mode, **options)


def layout(text, blocks, base, mode, most=1500, least=100):
    """Chunks by headings that blocks (text, font_size, is_bold, is_centered) show."""
    text = clean(text, mode)
    flat, heads = re.sub(r"\s+", " ", text), []
    for b in blocks:
        shown, size = (b["text"] or "").strip(), base if b["font_size"] is None else b["font_size"]
        if 1 <= len(shown) <= 200 and (size >= 1.2 * base or b["is_bold"] or b["is_centered"]):
            at = flat.find(re.sub(r"\s+", " ", shown))
            if at >= 0:
                heads.append((at, len(heads), shown, 1 if size >= 1.5 * base else 2 if size >= 1.3 * base else 3))
    plain = [chunk(t, f"fallback_{i}", [], 0, len(t)) for i, t in enumerate(pack(paragraphs(text), most))]
    if not blocks:
        return merged(plain, least)
    if not heads:
        return merged([chunk(text, "section_0", [], 0, len(text))] if len(text) <= most else plain, least)
    heads.sort()
    out, stack = [], []
    for i, (at, _, shown, level) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else len(text)
        content = text[at + len(shown) : max(end, at + len(shown))].strip()
        stack = [s for s in stack if s[0] < level] + [(level, shown)]
        path = [s[1] for s in stack]
        if len(content) <= most:
            out.append(chunk(content, f"section_{i}", path, at, end))
            continue
        texts = pack(paragraphs(content), most)
        out += [chunk(f"{shown}\n\n{t}".strip(), f"section_{i}_part_{j}", path, at, at + len(t if j < len(texts) - 1 else content)) for j, t in enumerate(texts)]
    return merged(out, least)
