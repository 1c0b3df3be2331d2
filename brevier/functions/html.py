"""Article text from HTML, sentence chunks and paragraph cleaning, for use in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

DROPPED = ("script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "form")
VOID = ("br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track")
# Where an article's paragraphs lie, by medium and in order of trust.
GENERIC = ("article", "[itemprop=articleBody]", ".article-body", ".story-body", ".entry-content", ".post-content", "main")
SELECTORS = {
    "TASS": ("[class*=news-text]", "[class*=text-block]", "[class*=article-text]", "[itemprop=articleBody]", "article", "main"),
    "ROSSIYSKAYA_GAZETA": (
        "[class*=b-material-wrapper__text]", "[class*=b-material-text]", "[class*=article__text]", "[itemprop=articleBody]", "article", "main",
    ),
}
# Markers of page furniture in article text.
STOP_MARKERS = (
    "читайте также", "related article", "related gallery", "sign up for", "обсуждения", "обратная связь", "вход на сайт",
    "восстановление пароля", "чтобы участвовать в дискуссии", "правила для комментариев",
)
DISCARD_MARKERS = (
    "регистрация пройдена успешно", "пожалуйста, перейдите по ссылке из письма", "отправить еще раз", "показать тут шапка",
    "эти несложные правила помогут вам получать удовольствие от общения на нашем сайте",
    "сообщение не должно содержать более 2500 знаков", "в комментариях запрещаются", "давайте будем уважать друг друга и сайт",
    "администрация сайта оставляет за собой право удалять комментарии", "scan the qr code", "editor’s note:", "editor's note:",
    "the views expressed in this commentary", "the content is produced solely by the conversation", "our live coverage for the day has ended",
)
TEXT_MARKERS = ("текст:", "text:")
LEAST_ARTICLE, LEAST_PARAGRAPHS, LEAST_CLEAN, PREFIX, LATE_TITLE, SHORT = 280, 120, 80, 2500, 160, 40


def _matches(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element is what a simple selector names: a tag, a class, or an attribute's value or part of it."""
    if selector.startswith("."):
        return selector[1:] in (attrs.get("class") or "").split()
    if selector.startswith("["):
        name, _, value = selector[1:-1].partition("=")
        held = attrs.get(name.rstrip("*")) or ""
        return value in held if name.endswith("*") else value == held
    return tag == selector


class _Reader(HTMLParser):
    """Collects paragraphs, each with the selectors that an element around it matches, and all body text."""

    def __init__(self, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.stack, self.off = selectors, [], 0
        self.open_p: list[str] | None = None
        self.paragraphs: list[tuple[set[str], str]] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        if tag == "p":
            self._close()
            self.open_p = []
        named = dict(attrs)
        self.stack.append((tag, {s for s in self.selectors if _matches(s, tag, named)}))
        self.off += tag in DROPPED

    def handle_endtag(self, tag):
        if tag == "p" or self.open_p is not None and tag in ("div", "article", "main", "section", "body"):
            self._close()
        if tag in [t for t, _ in self.stack]:
            while True:
                t, _ = self.stack.pop()
                self.off -= t in DROPPED
                if t == tag:
                    break

    def _close(self):
        if self.open_p is not None:
            text = squeeze("".join(self.open_p))
            if text:
                self.paragraphs.append((set().union(*(m for _, m in self.stack)), text))
            self.open_p = None

    def handle_data(self, data):
        if not self.off:
            self.body.append(data)
            if self.open_p is not None:
                self.open_p.append(data)


def squeeze(text: str) -> str:
    """NBSP to space, blanks squeezed, newlines kept, three or more to two, ends stripped."""
    text = re.sub(r"[^\S\n]+", " ", text.replace(" ", " ").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def article_text(html: str | None, media: str | None = None) -> str:
    """The paragraphs under the first place that gives 280 characters, else all if they are
    120, else the body's text.  The places depend on the medium."""
    selectors = SELECTORS.get((media or "").strip().upper(), GENERIC)
    reader = _Reader(selectors)
    reader.feed(html or "")
    reader.close()
    reader._close()
    for s in selectors:
        inside = "\n\n".join(t for marks, t in reader.paragraphs if s in marks)
        if len(inside) >= LEAST_ARTICLE:
            return inside
    everything = "\n\n".join(t for _, t in reader.paragraphs)
    return everything if len(everything) >= LEAST_PARAGRAPHS else squeeze(" ".join(reader.body))


def plain_text(html: str | None) -> str:
    """The text of some HTML, white space squeezed."""
    reader = _Reader(())
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.body).split())


def chunks(text: str | None, most: int = 1500) -> list[str]:
    """Whole sentences packed greedily into chunks; a longer sentence is cut."""
    out, held = [], ""
    for s in re.split(r"(?<=[.!?…])\s+", (text or "").strip()):
        if not s:
            continue
        if len(s) > most:
            if held:
                out.append(held)
            out += [s[i : i + most] for i in range(0, len(s), most)]
            held = ""
        elif held and len(held) + 1 + len(s) > most:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}" if held else s
    return out + [held] if held else out


def message_parts(text: str, most: int = 3900, least: int = 200) -> list[str]:
    """A message cut into parts of at most ``most`` characters, at a blank line where one lies
    more than ``least`` characters into the part."""
    parts, rest = [], text
    while len(rest) > most:
        gap = rest.rfind("\n\n", 0, most + 2)
        at = gap if gap > least else most
        parts.append(rest[:at].strip())
        rest = rest[at:]
    return [*parts, rest.strip()] if parts else [rest]


def without_head(text: str, title: str) -> str:
    """``text`` from its title on: the last place of several in the head, or a single late one."""
    at = [m.start() for m in re.finditer(re.escape(title), text) if m.start() < PREFIX] if title else []
    if len(at) > 1 or at and at[0] > LATE_TITLE:
        return text[at[-1] :]
    return text


def _noise(p: str) -> bool:
    low = p.lower()
    many = len(re.findall(r"https?://\S+", p)) >= 2 or len(re.findall(r"\b\d{1,2}:\d{2}\b", p)) >= 2
    return any(m in low for m in DISCARD_MARKERS) or many or (len(p) < SHORT and p[-1] not in ".!?")


def clean_article(title: str | None, description: str | None, raw: str | None) -> str:
    """Paragraphs without metadata, repeated titles, page furniture and repeats; nothing after
    a stop marker or a second text marker.  A result of under 80 characters gives way to title
    and description."""
    title, kept, seen, marked = squeeze(title or ""), [], set(), False
    for paragraph in re.split(r"(?:\n\s*){2,}", without_head(squeeze(raw or ""), title)):
        p = squeeze(paragraph)
        stop = any(m in p.lower() for m in STOP_MARKERS)
        if title and p.startswith(title):
            while p.startswith(title):
                p = squeeze(p[len(title) :])
            p = re.sub(r"^[!-/:-@\[-`{-~\s]+", "", p)
        if not p:
            continue
        if kept and stop:
            break
        if p.lower().startswith(TEXT_MARKERS):
            if marked and kept:
                break
            marked = True
        elif not _noise(p) and p.lower() not in seen:
            seen.add(p.lower())
            kept.append(p)
    out = "\n\n".join(kept)
    instead = "\n\n".join(x for x in (plain_text(title), plain_text(description)) if x)
    return out if len(out) >= LEAST_CLEAN or not instead else instead
