"""HTML extraction by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is read as a vector: the sum of the learned vectors
of its tag path (elements, words of classes, ids and roles, hashed), the mean of the learned vectors of its
hashed words, and a few measures. A bidirectional LSTM, in numpy, reads the whole sequence, so that
every block is labelled in the context of the page. Blocks labelled as main text are joined by blank lines.

The model is trained when the query starts. Pages have no labels, so training pages are laid out at random
from a table of page regions (menus, notices, comments and so on, with usual names). Their text is of a sample of at
most ``SAMPLE_PAGES`` pages, at most ``SAMPLE_BLOCKS`` blocks of each: long blocks with few links and sentence ends go
mostly to main regions, the others and usual phrases of menus and notices mostly to other regions. In a part of the
training pages names are left out or replaced by unknown ones, so that elements, words, measures and the blocks
around must decide there.

Defined cases: a null or empty page gives empty text, as does one without main text; unclosed elements end
where HTML ends them or with their parent; cut-off pages keep what came; repeated rows are extracted
alike; an empty table gives no rows; other columns are kept by ``extract`` and those named text replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, table
from kgspark.llm.html_blocks import blocks

PATHS, PATH_DIM, WORDS, WORD_DIM, MEASURES, HIDDEN = 1 << 12, 16, 1 << 12, 8, 4, 20
INPUT = PATH_DIM + WORD_DIM + MEASURES
#: Bound on the pages that training text is taken from, and the number of pages laid out from it.
SAMPLE_PAGES, SAMPLE_BLOCKS, TRAINING_PAGES, EPOCHS = 150, 40, 1200, 12
#: Places (pages times the longest page's blocks) that are labelled at once.
PLACES = 1 << 16
#: Share of training pages without names, and of those with unknown ones.
NAMELESS, RENAMED = 0.1, 0.1

#: Elements and names of page regions, by whether their text is the article's.
MAIN = [
    "article", "main", "article .post", "div .content", "div .article", "div .entry content", "div .post content", "div .post body", "div .article body",
    "section .story", "div .main content", "main .content", "div .text", "section", "div", "", "div .page main", "section .body", "div .markdown body", "div .story body",
]
OTHER = [
    "nav", "nav .menu", "nav .navbar", "div .nav", "div .menu", "ul .menu", "div .breadcrumbs", "div .breadcrumb", "ol .breadcrumb", "div .pagination", "nav .pager", "div .toc", "div .navigation", "div .toolbar", "div .tabs",
    "header", "header .site header", "div .header", "div .masthead", "div .topbar", "div .branding", "div .site title", "div .banner", "div .hero banner", "header .banner",
    "footer", "footer .site footer", "div .footer", "div .copyright", "div .legal", "div .colophon", "div .bottom", "div .imprint",
    "aside", "aside .sidebar", "div .sidebar", "div .side", "div .widget", "div .related", "section .related posts", "div .recommended", "div .trending", "div .most read", "div .popular", "div .teaser", "aside .complementary", "div .tags", "div .categories", "div .author bio", "div .meta",
    "div .notice", "div .cookie notice", "div .cookie", "div .consent", "div .gdpr", "div .alert", "div .popup", "div .modal", "div .newsletter", "div .paywall", "div .disclaimer", "section .notice", "div .overlay", "div .message", "p .notice", "div .warning", "div .announcement", "dialog",
    "div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "div .promo", "div .adsense", "aside .ad", "div .ad slot", "section .promoted", "div .dfp", "ins .adsbygoogle", "p .ad", "div .commercial", "div .sponsor",
    "form", "form .search", "div .search", "form .login", "div .subscribe", "form .subscribe", "fieldset", "div .signup", "div .contact form", "div .login",
    "section .comments", "div .comments", "div .comment", "ol .comment list", "div .comment body", "div .replies", "div .discussion", "article .comment", "div .disqus thread", "li .comment", "ul .comments", "div .respond", "div .reviews", "section .discussion", "div .user comments", "div .reader comments", "div .feedback",
    "div .share", "div .social", "ul .social links", "div .sharing", "button", "menu", "div .skip link",
]
#: Usual phrases of other regions.
PHRASES = [
    "Home", "About us", "Contact", "Log in", "Sign up", "Search", "Menu", "Skip to content", "Next page", "Previous", "Read more", "Share this article", "Follow us on social media",
    "We use cookies to improve your experience on this site.", "Accept all cookies", "Privacy policy", "Terms of service", "All rights reserved.", "Copyright 2024", "Subscribe to our newsletter",
    "Sign up for our weekly newsletter and never miss a story.", "Enter your email address", "Advertisement", "Sponsored content", "Buy now and save on your first order today!", "Related articles", "Most read", "Popular posts",
    "Leave a comment", "Reply", "Great post, thanks for sharing!", "I agree with the author.", "Posted by admin", "3 comments", "Report this comment", "Tags", "Categories", "Archive", "You have reached your limit of free articles.",
    "Accueil", "Contactez-nous", "Tous droits réservés.", "Nous utilisons des cookies.", "S'abonner à la newsletter", "Startseite", "Impressum", "Datenschutz", "Wir verwenden Cookies.", "Alle Rechte vorbehalten.", "Newsletter abonnieren",
    "Inicio", "Contacto", "Todos los derechos reservados.", "Utilizamos cookies.", "Suscríbete al boletín",
]
LEAVES = ["p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "div", "td", "figcaption", "dd"]


def _bucket(mark: str, size: int, salt: int) -> int:
    return zlib.crc32(mark.encode("utf-8", "surrogatepass"), salt) % size


class Reader:
    """Blocks to index lists and measures."""

    def __init__(self):
        self.path = lru_cache(50_000)(self._path)
        self.word = lru_cache(200_000)(lambda w: _bucket(w, WORDS, 2))

    @staticmethod
    def _path(path: tuple[str, ...]) -> tuple[int, ...]:
        kept = [m for m in path if m not in ("html", "body")]
        marks = {"/" + ("" if not kept else kept[-1]), *kept, "<>"}
        return tuple(sorted(_bucket(m, PATHS, 1) for m in marks))

    def __call__(self, path: tuple[str, ...], text: str, linked: float) -> tuple[tuple[int, ...], list[int], tuple[float, ...]]:
        words = text.lower().split()
        ends = sum(text.count(c) for c in ".!?")
        return self.path(path), list(map(self.word, words)), (np.log1p(len(words)) / 4, linked, min(1.0, ends / len(words)), 1.0)


def _sums(vectors: np.ndarray, lists: list, mean: bool) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    out = np.add.reduceat(vectors[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    return out / sizes[:, None] if mean else out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    model = {"path": random.normal(0, 0.1, (PATHS, PATH_DIM)), "word": random.normal(0, 0.1, (WORDS, WORD_DIM)), "out": random.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for way in ("f", "b"):
        model["w" + way] = random.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN, 4 * HIDDEN))
        model["c" + way] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return model


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Over (time, pages, input); states stay as they are where the mask is 0."""
    steps, pages, _ = x.shape
    h, s = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    out, trace = np.zeros((steps, pages, HIDDEN), x.dtype), []
    given = x.reshape(steps * pages, -1) @ w[:INPUT]
    given = given.reshape(steps, pages, -1) + c
    for t in range(steps):
        z = given[t] + h @ w[INPUT:]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * s + i * g
        tanh = np.tanh(new)
        if keep:
            trace.append((h, s, i, f, o, g, tanh))
        h, s = m * o * tanh + (1 - m) * h, m * new + (1 - m) * s
        out[t] = h
    return out, trace


def _lstm_back(x: np.ndarray, mask: np.ndarray, w: np.ndarray, trace: list, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the weights, the bias and the input."""
    steps, pages, _ = x.shape
    dw, dc, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros_like(x)
    dh, ds = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, s, i, f, o, g, tanh = trace[t]
        m = mask[t][:, None]
        dh = dh + above[t]
        inner, stay_h, stay_s = dh * m, dh * (1 - m), ds * (1 - m)
        dnew = ds * m + inner * o * (1 - tanh**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * s * f * (1 - f), inner * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        dw[:INPUT] += x[t].T @ dz
        dw[INPUT:] += h.T @ dz
        dc += dz.sum(axis=0)
        back = dz @ w.T
        dx[t] = back[:, :INPUT]
        dh, ds = back[:, INPUT:] + stay_h, dnew * f + stay_s
    return dw, dc, dx


def _lay_out(model: dict, pages: list[list]) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
    """(time, pages, input), mask, path and word lists, and the place of each block in it."""
    flat = [b for page in pages for b in page]
    paths, words = [b[0] for b in flat], [b[1] for b in flat]
    rows = np.concatenate([_sums(model["path"], paths, False), _sums(model["word"], words, True), np.array([b[2] for b in flat])], axis=1)
    sizes = np.array([len(p) for p in pages])
    place = np.concatenate([np.arange(n) * len(pages) + k for k, n in enumerate(sizes)])
    steps = int(sizes.max())
    x = np.zeros((steps * len(pages), INPUT), model["path"].dtype)
    x[place] = rows
    mask = (np.arange(steps)[:, None] < sizes[None, :]).astype(x.dtype)
    return x.reshape(steps, len(pages), INPUT), mask, paths, words, place


def _states(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list, list]:
    """Both directions. The backward one starts at the padding, where its state stays zero."""
    forth, trace_f = _lstm(x, mask, model["wf"], model["cf"], keep)
    back, trace_b = _lstm(x[::-1], mask[::-1], model["wb"], model["cb"], keep)
    return np.concatenate([forth, back[::-1]], axis=2), trace_f, trace_b


def probabilities(model: dict, pages: list[list]) -> list[np.ndarray]:
    """Chance of main text of each block of each page; pages have at least one block."""
    x, mask, _, _, place = _lay_out(model, pages)
    states, _, _ = _states(model, x, mask, False)
    chance = _sigmoid(states.reshape(-1, 2 * HIDDEN)[place] @ model["out"] + model["bias"][0])
    return np.split(chance, np.cumsum([len(p) for p in pages])[:-1])


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of (blocks, labels) pages."""
    model = new_model(seed)
    random = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step, size = 0, 32
    total = epochs * -(-len(pages) // size)
    for _ in range(epochs):
        order = random.permutation(len(pages))
        for at in range(0, len(order), size):
            some = [pages[k] for k in order[at : at + size]]
            x, mask, paths, words, place = _lay_out(model, [p[0] for p in some])
            states, trace_f, trace_b = _states(model, x, mask, True)
            flat = states.reshape(-1, 2 * HIDDEN)
            wanted = np.array([v for p in some for v in p[1]], float)
            error = (_sigmoid(flat[place] @ model["out"] + model["bias"][0]) - wanted) / len(wanted)
            grads = {"out": flat[place].T @ error, "bias": np.array([error.sum()])}
            above = np.zeros_like(flat)
            above[place] = error[:, None] * model["out"]
            above = above.reshape(states.shape)
            grads["wf"], grads["cf"], dx = _lstm_back(x, mask, model["wf"], trace_f, above[:, :, :HIDDEN])
            grads["wb"], grads["cb"], other = _lstm_back(x[::-1], mask[::-1], model["wb"], trace_b, above[::-1, :, HIDDEN:])
            rows = (dx + other[::-1]).reshape(-1, INPUT)[place]
            grads["path"], grads["word"] = np.zeros_like(model["path"]), np.zeros_like(model["word"])
            n_paths, n_words = np.array([len(p) for p in paths]), np.array([len(w) for w in words])
            np.add.at(grads["path"], np.concatenate(paths).astype(int), np.repeat(rows[:, :PATH_DIM], n_paths, axis=0))
            np.add.at(grads["word"], np.concatenate(words).astype(int), np.repeat(rows[:, PATH_DIM : PATH_DIM + WORD_DIM] / n_words[:, None], n_words, axis=0))
            step += 1
            now = rate * (1 - (step - 1) / total)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def is_prose(text: str, linked: float) -> bool:
    """Whether a block may be of an article by its own looks."""
    return linked < 0.3 and len(text.split()) >= 10 and any(c in text for c in ".!?")


def training_pages(texts: list[tuple[str, float]], n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[list[tuple[tuple[str, ...], str, float]], list[int]]]:
    """Random layouts: regions around and inside a main one, each with blocks of the given texts."""
    random = np.random.default_rng(seed)
    prose = [t for t, linked in texts if is_prose(t, linked)] or ["One sentence of a text that stands in an article."]
    others = [t for t, linked in texts if not is_prose(t, linked)] or PHRASES
    names: dict[str, str] | None = None  # of this page, where they are not the usual ones

    def pick(values: list) -> str:
        return values[random.integers(len(values))]

    def named(mark: str) -> str:
        return names.setdefault(mark, f".x{random.integers(1 << 30)}") if names is not None else mark

    def shown(path: tuple[str, ...]) -> tuple[str, ...]:
        if names is not None and nameless:
            return tuple(m for m in path if m[0] != ".")
        return tuple(named(m) if m[0] == "." else m for m in path)

    def marks(region: str) -> tuple[str, ...]:
        tag, *words = region.split() or [""]
        return (tag, *["." + w.lstrip(".") for w in words]) if tag else ()

    def said(short: bool, main: bool) -> str:
        # where names are known they decide, also about a phrase inside an article
        if random.random() < ((0.15 if not main else 0.1) if names is None else (0.35 if not main else 0)):
            return pick(PHRASES)
        words = pick(prose if (random.random() < (0.55 if names is None else 0.9)) == main else others).split()
        if short:
            at = random.integers(len(words))
            return " ".join(words[at : at + random.integers(1, 8)]) or "text"
        return " ".join(words)

    def region(above: tuple[str, ...], name: str, label: int, out: list, wanted: list) -> None:
        inner = above + marks(name)
        if random.random() < 0.25:
            inner += pick([("div",), ("section",), ("div", ".inner"), ("div", ".container"), ("div", ".wrap")])
        if label:
            if random.random() < 0.7:
                out.append((inner + ("h1",), said(random.random() < 0.5, True), 0.0))
                wanted.append(1)
            for _ in range(1 + min(40, int(random.exponential(6)))):
                if random.random() < 0.06:
                    region(inner, pick(OTHER), 0, out, wanted)
                leaf = pick(LEAVES)
                holder = {"li": ("ul",), "td": ("table", "tr"), "dd": ("dl",), "figcaption": ("figure",)}.get(leaf, ())
                out.append((inner + holder + (leaf,), said(random.random() < 0.2, True), float(random.random() < 0.05) * random.random()))
                wanted.append(1)
            if random.random() < 0.08:  # a short line many times over
                line, times = said(True, True), random.integers(5, 80)
                out += [(inner + ("p",), line, 0.0)] * times
                wanted += [1] * times
            if random.random() < 0.25:
                region(inner, pick(OTHER), 0, out, wanted)
        else:
            for _ in range(1 + int(random.exponential(2.5))):
                leaf = pick([("ul", "li"), ("p",), ("p",), (), ("h3",), ("div",), ("span",), ("label",), ("li",), ("article", ".comment", "p"), ("h2",)])
                out.append((inner + leaf, said(random.random() < 0.6, False), float(random.random() < 0.5)))
                wanted.append(0)

    made = []
    for _ in range(n):
        out: list = []
        wanted: list[int] = []
        draw = random.random()
        nameless = draw < NAMELESS
        names = {} if draw < NAMELESS + RENAMED else None
        above = ("html", "body") + pick([(), (), ("div", ".wrapper"), ("div", ".page"), ("div", ".container")])
        for _ in range(random.integers(0, 5)):
            region(above, pick(OTHER), 0, out, wanted)
        if random.random() < 0.97:
            region(above, pick(MAIN[:3]) if random.random() < 0.35 else pick(MAIN), 1, out, wanted)
        for _ in range(random.integers(0, 5)):
            region(above, pick(OTHER), 0, out, wanted)
        if out:
            made.append(([(shown(path), text, linked) for path, text, linked in out], wanted))
    return made


def sample_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[tuple[str, float]]:
    """(text, linked share) of at most SAMPLE_BLOCKS blocks of each of at most SAMPLE_PAGES pages, chosen by their ids alone."""
    bounded_batches(pages.sparkSession)
    ids = pages.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PAGES)
    some = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).join(F.broadcast(ids), "_id").select("_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b for page in batch.column(0).to_pylist() for b in blocks(page)[:SAMPLE_BLOCKS]]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(b.text.split()[:200]) for b in found], pa.string()), pa.array([b.linked for b in found], pa.float64())], names=["text", "linked"])

    return sorted({(r["text"], r["linked"]) for r in some.mapInArrow(run, "text string, linked double").collect()})


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """Trains on laid-out pages with the text of sampled ones."""
    read = Reader()
    return train([([read(*b) for b in page], wanted) for page, wanted in training_pages(sample_texts(pages, id_col, html_col))])


def extract(pages: DataFrame, model: dict[str, np.ndarray], html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text``: the main text of every row."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})  # of fixed size
    kept = [f for f in pages.schema.fields if f.name in keep and f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known = Reader(), shared.value
        for batch in batches:
            found = [blocks(p) for p in batch.column("_html").to_pylist()]
            texts = [""] * len(found)
            full = sorted((k for k, bs in enumerate(found) if bs), key=lambda k: len(found[k]))
            while full:
                # pages of like length, as many as their padded places allow
                longest = len(found[full[-1]])
                some = full[-max(1, min(64, PLACES // longest)) :]
                del full[-len(some) :]
                chances = probabilities(known, [[read(b.path, b.text, b.linked) for b in found[k]] for k in some])
                for k, chance in zip(some, chances, strict=True):
                    texts[k] = "\n\n".join(b.text for b, c in zip(found[k], chance, strict=True) if c >= 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], names=[*[f.name for f in kept], "text"])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "text string"])
    return pages.select(*[f.name for f in kept], F.col(html_col).alias("_html")).mapInArrow(run, kinds)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
