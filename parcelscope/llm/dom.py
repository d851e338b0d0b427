"""A page's blocks of text and the tree of its block elements, and the alignment of such trees."""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML, and the words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section "
    "select summary table tbody td template textarea tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html option td th tr tbody thead tfoot caption title legend summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select",)}
DROPPED = frozenset(
    "head title nav footer aside form menu noscript template textarea select option button iframe object svg canvas "
    "audio video dialog script style search".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription share sharing social sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies related "
    "recommended widget login signup search pagination pager skip contentinfo complementary".split())
ROOTS = frozenset("article main".split())
UNMARKED = frozenset("html body h1".split())  # with ROOTS: no word of a class, id or role makes these boilerplate

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
DEPTH = 150  # deeper elements belong to their ancestor at this depth; their text is kept


class Node:
    __slots__ = ("label", "children", "index", "bad", "root", "size")

    def __init__(self, label: str, bad: bool = False, root: bool = False):
        self.label, self.children, self.index, self.bad, self.root, self.size = label, [], -1, bad, root, 1


def _marks(attrs: str) -> tuple[str, bool, bool, bool]:
    """(first class or id without digits, is boilerplate by its words, is hidden, holds the article). A class
    counts only if all its words are marks: no-sidebar and article-header are none."""
    if not attrs or ("=" not in attrs and "hidden" not in attrs):
        return "", False, False, False
    name, bad, hidden, root = "", False, False, False
    for m in _NAMED.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "itemprop":
            root |= value == "articlebody"
        elif key in ("class", "id", "role"):
            words = _WORD.findall(value)
            name = name or "-".join(words[:3])
            if not BAD_WORDS.isdisjoint(words):
                bad |= any(BAD_WORDS.issuperset(w) for w in map(_WORD.findall, value.split()) if w)
            root |= key == "role" and value in ("main", "article")
    return name, bad, hidden, root


def parse(html: str) -> tuple[Node, list[tuple[Node, str, int]], bool]:
    """(tree of block elements, blocks, whether an element holds the article). A block is (element, text,
    characters of it inside links); boilerplate elements have none. An article or main element that is not
    inside another is the page's own, whatever words the elements around it have. A page without one, all
    of whose text is marked by words only, keeps that text."""
    top = Node("page")
    # open elements: (tag, node it belongs to, boilerplate (1 by words, 2 by element), inside the article, is a link)
    stack = [("", top, 0, False, False)]
    blocks: list[tuple[Node, str, int, bool, int]] = []
    parts: list[str] = []
    linked = at = 0
    rooted = False

    def flush():
        nonlocal linked
        if parts:
            _, node, bad, inside, _ = stack[-1]
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text and bad < 2:
                blocks.append((node, text, linked, inside, bad))
            parts.clear()
        linked = 0

    def pop_to(k: int):
        flush()
        del stack[k:]

    def text(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if stack[-1][4]:
                linked += len(raw)

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.search(html, pos)
        if m is None:
            text(html[pos:])
            break
        text(html[pos:m.start()])
        pos, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if k:
                    pop_to(k)
                else:
                    flush()
            else:  # an inline element ends; those opened inside a block end with it
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if any(stack[i][2] != s[2] for s in (stack[i - 1],)):
                            flush()
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>", re.I).search(html, pos)
            pos = close.end() if close else end
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] != "p":
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME[tag]:
                    pop_to(i)
                    if tag != "tr":
                        break
                elif stack[i][0] in STOPS[tag]:
                    break
        name, words, hidden, root = _marks(m[3])
        _, above, was_bad, inside, link = stack[-1]
        root = root or tag in ROOTS
        if hidden or tag in DROPPED or (tag == "header" and not inside):
            bad = 2
        elif root and not inside and was_bad < 2:
            bad = 0
        else:
            bad = max(was_bad, int(words and not root and tag not in UNMARKED))
        if tag in BLOCK:
            flush()
            node = above
            if len(stack) <= DEPTH:
                node = Node(f"{tag}.{name}" if name else tag, bad > 0, root)
                above.children.append(node)
            rooted |= root and not bad
            stack.append((tag, node, bad, inside or (root and not bad), link or tag == "a"))
        else:
            if bad != was_bad:
                flush()
            stack.append((tag, above, bad, inside or (root and not bad), link or tag == "a"))
    flush()
    chosen = [(n, t, k) for n, t, k, inside, bad in blocks if not bad and (inside or not rooted)]
    if not chosen and not rooted:
        chosen = [(n, t, k) for n, t, k, _, _ in blocks]
    return top, chosen, rooted


def collapsed(node: Node, into: dict[int, Node] | None = None) -> dict[int, Node]:
    """Fold siblings with one label into the first, all the way down; id of each node -> where it went."""
    into = {} if into is None else into
    into.setdefault(id(node), node)
    first: dict[str, Node] = {}
    kept = []
    for c in node.children:
        f = first.get(c.label)
        if f is None:
            first[c.label] = c
            kept.append(c)
        else:
            into[id(c)] = f
            f.children += c.children
    node.children = kept
    for c in kept:
        collapsed(c, into)
    return into


def numbered(node: Node) -> list[Node]:
    """All nodes in document order; each gets its place as index."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        n.index = len(out)
        out.append(n)
        todo += reversed(n.children)
    return out


def written(node: Node) -> str:
    return node.label + ("(" + ",".join(map(written, node.children)) + ")" if node.children else "")


def read(text: str) -> Node:
    top = Node("")
    path = [top]
    for m in re.finditer(r"([^(),]+)|([()])", text):
        if m[1]:
            path[-1].children.append(Node(m[1]))
        elif m[2] == "(":
            path.append(path[-1].children[-1])
        else:
            path.pop()
    return top.children[0]


def matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes that two trees share in order, roots and labels alike."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pair = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            s, p = matching(a.children[i - 1], b.children[j - 1])
            pair[i, j] = s, p
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + s)
    pairs, i, j = [(a, b)], m, n
    while i and j:
        s, p = pair[i, j]
        if s and best[i][j] == best[i - 1][j - 1] + s:
            pairs += p
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def aligned(trees: list[str]) -> tuple[str, list[list[int]]]:
    """(wrapper, for each tree the wrapper's node of each of its nodes). The wrapper starts as the first
    tree and takes in what the others add, in their order."""
    wrapper, placed = None, []
    for t in trees:
        tree = read(t)
        nodes = numbered(tree)
        if wrapper is None:
            wrapper = tree
            placed.append(nodes)
            continue
        to = {id(b): a for a, b in matching(wrapper, tree)[1]}

        def add(node: Node, host: Node, to=to):
            before = 0
            for c in node.children:
                a = to.get(id(c))
                if a is None:
                    host.children.insert(before, c)
                    before += 1
                else:
                    before = max(before, next(i for i, x in enumerate(host.children) if x is a) + 1)
                    add(c, a)

        own = list(nodes)
        if id(tree) in to:
            add(tree, wrapper)
            placed.append([to.get(id(n), n) for n in own])
        else:  # another root: keep both below a new one
            top = Node("any")
            top.children = [wrapper, tree]
            wrapper = top
            placed.append(own)
    numbered(wrapper)
    return written(wrapper), [[n.index for n in p] for p in placed]
