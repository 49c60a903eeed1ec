"""Element selectors over the parsed arrays (H2-H26) as higher-order column expressions.

``el`` arguments are element arrays such as ``anchors`` or ``nodes``. Attribute tests follow the
audited rules to the letter: some ignore case, some do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import urls as U
from .text import collapse, text_or_empty, trim_blank, word_count

Test = Callable[[Column], Column]


def attr(element: Column, name: str) -> Column:
    """Attribute text, NULL when absent."""
    return element["attrs"].getItem(name)


def attr_or(element: Column, name: str, default: str = "") -> Column:
    return F.coalesce(attr(element, name), F.lit(default))


def has(element: Column, name: str) -> Column:
    return attr(element, name).isNotNull()


def has_text_attr(element: Column, name: str) -> Column:
    return attr_or(element, name) != ""


def style_has(element: Column, *marks: str) -> Column:
    style = attr_or(element, "style")
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(style, F.lit(mark))
    return out


def select(el: Column, test: Test) -> Column:
    return F.filter(el, test)


def n(el: Column, test: Test) -> Column:
    return F.size(F.filter(el, test))


def any_of(el: Column, test: Test) -> Column:
    return F.exists(el, test)


def first(el: Column, test: Test | None = None) -> Column:
    """First element in document order, NULL for none."""
    return F.get(F.filter(el, test) if test else el, 0)


def texts(el: Column) -> Column:
    return F.transform(el, lambda e: text_or_empty(e["text"]))


def joined(el: Column, sep: str = " ") -> Column:
    return F.array_join(texts(el), sep)


def tag_count(tag: str) -> Column:
    return F.coalesce(F.col("tag_counts").getItem(tag), F.lit(0))


def tag_total(*tags: str) -> Column:
    return sum((tag_count(t) for t in tags[1:]), tag_count(tags[0]))


def tagged(el: Column, *tags: str) -> Column:
    return F.filter(el, lambda e: e["tag"].isin(*tags))


def inside(element: Column, tag: str) -> Column:
    return F.contains(element["up"], F.lit(f"/{tag}/"))


def contains_element(outer: Column, inner: Column) -> Column:
    """Preorder containment: ``inner`` lies below ``outer``."""
    return (inner["ord"] > outer["ord"]) & (inner["ord"] <= outer["last"])


def class_lines(pattern: str, flags: str = "") -> Column:
    """Number of elements whose class attribute matches."""
    return P.count(F.col("class_text"), f"^.*(?:{pattern}).*$", "m" + flags)


def id_lines(pattern: str, flags: str = "") -> Column:
    return P.count(F.col("id_text"), f"^.*(?:{pattern}).*$", "m" + flags)


# --- metas and canonicals -----------------------------------------------------------------------


def meta_first(name: str, key: str = "name") -> Column:
    """H2: content of the first meta with exactly this name."""
    return text_or_empty(attr(first(F.col("metas"), lambda m: attr(m, key) == name), "content"))


def meta_robots_first() -> Column:
    """H2, first-match form, lower case."""
    hit = first(F.col("metas"), lambda m: attr_or(m, "name").isin("robots", "googlebot"))
    return F.lower(text_or_empty(attr(hit, "content")))


def meta_robots_joined(*names: str) -> Column:
    """H2, joined form: every matching meta, names compared without case."""
    hits = F.filter(F.col("metas"), lambda m: F.lower(attr_or(m, "name")).isin(*names))
    return F.array_join(F.transform(hits, lambda m: attr_or(m, "content")), ",")


def link_first(rel: str, case_free: bool = False) -> Column:
    key = (lambda e: F.lower(attr_or(e, "rel"))) if case_free else (lambda e: attr_or(e, "rel"))
    return first(F.col("link_tags"), lambda e: key(e) == rel)


def links_rel(rel: str, extra: Test | None = None, case_free: bool = False) -> Column:
    key = (lambda e: F.lower(attr_or(e, "rel"))) if case_free else (lambda e: attr_or(e, "rel"))
    return F.filter(F.col("link_tags"), lambda e: (key(e) == rel) & (extra(e) if extra else F.lit(True)))


def canonical_tag() -> Column:
    """H3: canonical of the link tag as written, resolved."""
    hit = link_first("canonical")
    return F.when(text_or_empty(attr(hit, "href")) != "", hit["abs"]).otherwise("")


def canonical_combined(header_value: Column) -> Column:
    """H3: link tag first, ``Link`` header second."""
    hit = link_first("canonical", case_free=True)
    return F.when(text_or_empty(attr(hit, "href")) != "", hit["abs"]).otherwise(header_value)


# --- headings -----------------------------------------------------------------------------------


def level(heading: Column) -> Column:
    return F.substring(heading["tag"], 2, 1).cast("int")


def visible_headings() -> Column:
    """H4: headings neither hidden themselves nor by an ancestor."""
    return F.filter(F.col("headings"), lambda h: ~h["hid"])


def level_jumps(headings: Column) -> Column:
    """Positions where the level rises by more than one."""
    levels = F.transform(headings, level)
    rises = F.zip_with(
        F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))),
        F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))),
        lambda now, before: F.struct(before.alias("from"), now.alias("to")),
    )
    return F.filter(rises, lambda r: r["to"] - r["from"] > 1)


def first_h1() -> Column:
    return text_or_empty(first(F.col("headings"), lambda h: h["tag"] == "h1")["text"])


# --- links --------------------------------------------------------------------------------------


def hrefs() -> Column:
    """All ``a[href]``."""
    return F.filter(F.col("anchors"), lambda a: has(a, "href"))


def internal_links(site: Column) -> Column:
    """H5: links to the same site; ``site`` is its host without ``www.``."""
    return F.filter(F.col("anchors"), lambda a: (a["host"] == site) & (site != ""))


def outbound_links(site: Column) -> Column:
    """H5: links written with an http address that leave the site."""
    return F.filter(
        F.col("anchors"), lambda a: attr_or(a, "href").startswith("http") & (F.coalesce(a["host"], F.lit("")) != site)
    )


def footer_link(pattern: str) -> Column:
    """H5: first footer link whose address or text matches."""
    return first(
        hrefs(), lambda a: inside(a, "footer") & (P.test(attr(a, "href"), pattern) | P.test(a["text"], pattern))
    )


def matching_link(site: Column, pattern: str) -> Column:
    """First same-site link whose resolved address or text matches."""
    return first(
        internal_links(site), lambda a: P.test(a["abs"], pattern) | P.test(collapse(a["text"]), pattern)
    )


def plain_link(pattern: str) -> Column:
    """First link whose written address or text matches, on any site."""
    return first(hrefs(), lambda a: P.test(attr(a, "href"), pattern) | P.test(a["text"], pattern))


def see_also_count() -> Column:
    """H5: related-reading links, counted once per enclosing section-like element."""
    words = r"\b(see also|related|learn more|next|recommended|further reading|resources)\b"
    hits = F.filter(hrefs(), lambda a: a["rel"] | P.test(a["text"], words))
    around = F.transform(
        hits, lambda a: F.size(F.filter(F.split(a["up"], "/"), lambda t: t.isin("section", "article", "main", "aside", "footer")))
    )
    return F.aggregate(around, F.lit(0), lambda acc, x: acc + x)


def contextual_internal(site: Column) -> Column:
    """H5: same-site links inside a paragraph."""
    return F.filter(internal_links(site), lambda a: inside(a, "p"))


# --- assets -------------------------------------------------------------------------------------

_ASSET = "array<struct<url:string,kind:string>>"


def assets(page_url: Column) -> Column:
    """H6: the page and everything it loads, with kinds, first occurrence first."""
    nothing = F.array().cast(_ASSET)

    def one(url: Column, kind: Column) -> Column:
        return F.struct(url.alias("url"), kind.alias("kind"))

    def usable(e: Column) -> Column:
        return text_or_empty(e["abs"]).rlike("^(?!data:|blob:|mailto:|tel:).")

    rel = lambda e: F.lower(attr_or(e, "rel"))
    as_ = lambda e: F.lower(attr_or(e, "as"))
    link_kind = lambda e: (
        F.when(F.contains(rel(e), F.lit("stylesheet")), "css")
        .when((as_(e) == "font") | (F.contains(rel(e), F.lit("preload")) & P.test(attr(e, "href"), "font")), "font")
        .when((as_(e) == "image") | F.contains(rel(e), F.lit("icon")), "image")
        .when(rel(e).rlike("manifest|alternate"), U.asset_kind(e["abs"]))
    )
    of_links = F.transform(
        F.filter(F.col("link_tags"), lambda e: has(e, "href") & usable(e) & link_kind(e).isNotNull()),
        lambda e: one(e["abs"], link_kind(e)),
    )
    of_scripts = F.transform(
        F.filter(F.col("scripts"), lambda e: has(e, "src") & usable(e)), lambda e: one(e["abs"], F.lit("js"))
    )
    pictures = F.array_sort(
        F.concat(
            F.filter(F.col("images"), lambda e: has(e, "src")),
            F.filter(F.col("nodes"), lambda e: (e["tag"] == "source") & has(e, "src")),
        ),
        lambda a, b: a["ord"] - b["ord"],
    )
    of_pictures = F.flatten(
        F.transform(
            pictures,
            lambda e: F.concat(
                F.when(usable(e), F.array(one(e["abs"], F.lit("image")))).otherwise(nothing),
                F.transform(U.srcset_urls(attr(e, "srcset")), lambda u: one(resolve_reference(page_url, u), F.lit("image"))),
            ),
        )
    )
    page = F.array(one(page_url, F.lit("html")))
    return F.concat(page, of_links, of_scripts, of_pictures)


def resolve_reference(base: Column, reference: Column) -> Column:
    """Resolve a ``srcset`` entry: absolute, scheme-relative, root-relative or in the page's folder."""
    folder = F.regexp_replace(U.path(base), "[^/]*$", "")
    return (
        F.when(U.is_url(reference), reference)
        .when(reference.startswith("//"), F.concat(U.scheme(base), F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(U.origin(base), reference))
        .otherwise(F.concat(U.origin(base), folder, reference))
    )


# --- images -------------------------------------------------------------------------------------


def image_stats() -> Column:
    """H7: counts of one page's images."""
    images = F.col("images")
    src = lambda e: attr_or(e, "src")
    shown = F.filter(images, lambda e: (attr_or(e, "role") != "presentation") & (attr_or(e, "aria-hidden") != "true"))
    charts = F.filter(images, lambda e: P.test(src(e), "chart|graph|infographic|data"))
    below = F.slice(images, 3, F.greatest(F.size(images), F.lit(1)))
    detailed = lambda e: (word_count(attr(e, "alt")) >= 8) | (F.length(trim_blank(attr_or(e, "alt"))) >= 40)
    return F.struct(
        F.size(images).alias("total"),
        F.size(shown).alias("shown"),
        n(shown, lambda e: trim_blank(attr_or(e, "alt")) != "").alias("alt"),
        n(images, lambda e: has_text_attr(e, "width") & has_text_attr(e, "height")).alias("sized"),
        n(images, lambda e: P.test(src(e), r"\.(webp|avif)(\?|$)")).alias("modern"),
        n(images, lambda e: U.is_generic_file(src(e))).alias("generic"),
        F.size(charts).alias("charts"),
        n(charts, detailed).alias("charts_detailed"),
        F.size(below).alias("below"),
        n(below, lambda e: F.lower(attr_or(e, "loading")) == "lazy").alias("below_lazy"),
    )


def content_images() -> Column:
    """H8: images that are neither presentational nor hidden from assistive tools."""
    return F.filter(
        F.col("images"), lambda e: (F.lower(attr_or(e, "role")) != "presentation") & (attr_or(e, "aria-hidden") != "true")
    )


def image_source(e: Column) -> Column:
    """H8: ``src`` with ``data-src`` as fallback for an empty one."""
    return F.coalesce(F.when(attr_or(e, "src") != "", attr(e, "src")), attr(e, "data-src"), F.lit(""))


def video_count(extra_host: bool = True) -> Column:
    hosts = "youtube|youtu\\.be|vimeo" if extra_host else "youtube|vimeo"
    frames = n(F.col("nodes"), lambda e: (e["tag"] == "iframe") & P.test(attr(e, "src"), hosts, ""))
    return tag_count("video") + frames


STOCK_HOSTS = (
    r"shutterstock\.com|gettyimages\.com|istockphoto\.com|unsplash\.com|pexels\.com|freepik\.com|"
    r"depositphotos\.com|stock\.adobe\.com|dreamstime\.com|123rf\.com"
)


def sourced_images() -> Column:
    """H9: images with an address, as (src, alt)."""
    pairs = F.transform(
        F.col("images"),
        lambda e: F.struct(
            F.coalesce(attr(e, "src"), attr(e, "data-src"), F.lit("")).alias("src"), attr_or(e, "alt").alias("alt")
        ),
    )
    return F.filter(pairs, lambda p: p["src"] != "")


def transcript_text() -> Column:
    """H9: text of transcript-like elements."""
    marks = lambda e: F.concat_ws("\n", attr(e, "class"), attr(e, "id"))
    hits = F.filter(
        F.col("nodes"),
        lambda e: F.contains(text_or_empty(marks(e)), F.lit("transcript"))
        | ((e["tag"] == "section") & F.contains(text_or_empty(e["text"]), F.lit("Transcript")))
        | (e["tag"] == "track"),
    )
    return collapse(joined(hits, ""))


# --- hidden text --------------------------------------------------------------------------------


def every_element() -> Column:
    """All elements the parser kept, in no particular order."""
    return F.concat(F.col("nodes"), F.col("headings"), F.col("anchors"), F.col("images"))


def words_of(el: Column) -> Column:
    counts = F.transform(el, lambda e: word_count(e["text"]))
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)


def hidden_words() -> Column:
    """H11, simple form."""
    return words_of(F.filter(every_element(), lambda e: style_has(e, "display:none") | has(e, "hidden")))


def hidden_words_aria() -> Column:
    """H11 with ``aria-hidden`` counted as well."""
    return words_of(
        F.filter(
            every_element(),
            lambda e: style_has(e, "display:none") | has(e, "hidden") | (attr_or(e, "aria-hidden") == "true"),
        )
    )


def hidden_words_outside_regions() -> Column:
    """H11, region form: menus, dialogs, tabs and page furniture do not count."""
    style = lambda e: F.lower(attr_or(e, "style"))
    hidden = lambda e: has(e, "hidden") | P.test(style(e), "display:none|visibility:hidden|opacity:0", "")
    return words_of(F.filter(every_element(), lambda e: hidden(e) & ~e["excl"]))


_RESPONSIVE = (
    r"(?:^|\s)(elementor-hidden-(?:desktop|tablet|mobile|phone)|e-con-inner|vc_hidden-(?:xs|sm|md|lg)|et_pb_hidden|"
    r"et-hide-(?:mobile|tablet)|d(?:-(?:sm|md|lg|xl))?-none|hidden-(?:xs|sm|md|lg)|(?:sm|md|lg|xl):hidden|"
    r"oxy-hide-on-(?:mobile|tablet)|hide-(?:mobile|tablet|desktop)|(?:mobile|tablet|desktop)-hidden|"
    r"show-(?:mobile|desktop))(?:\s|$)"
)
_FURNITURE = (
    r"\b(modal|menu|nav|sidebar|overlay|drawer|offcanvas|dropdown|tooltip|popup|burger|hamburger|flyout|panel|skip|"
    r"screen-reader|sr-only|visually-hidden|showBottomAction|hover|show-on-hover|reveal|product-action|card-action|"
    r"quick-action)\b"
)
_UI_WORDS = "wishlist|add to bag|add to cart|preview|preview shades|quick view|buy now"
# Class words that explain hidden text, first match wins.
_EXPLAINED = (
    ("accordion", r"\b(accordion|collapse|collapsible|faq)\b"),
    ("tab", r"\b(tab-pane|tab-content)\b"),
    ("offscreen", r"\b(offscreen|off-screen|visually-hidden|sr-only)\b"),
    ("animation", r"\b(animate|aos|fade|slide)\b"),
)


def hidden_classes() -> Column:
    """H11, classifying form: words of hidden elements per class of reason."""
    style = lambda e: attr_or(e, "style")
    hidden = lambda e: (
        P.test(style(e), r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0")
        | has(e, "hidden")
        | P.test(attr(e, "class"), r"\b(d-none|hidden|invisible|sr-only|visually-hidden|hide|collapsed)\b")
    )

    def kind(e: Column) -> Column:
        cls = attr_or(e, "class")
        text = collapse(e["text"])
        furniture = (
            P.test(cls, _RESPONSIVE)
            | e["tag"].isin("nav", "header", "footer", "aside", "script", "style")
            | P.test(attr(e, "role"), "dialog|modal|navigation")
            | (attr_or(e, "aria-hidden") == "true")
            | P.test(cls, _FURNITURE)
            | e["up"].rlike("/(nav|header|footer)/")
        )
        duplicate = (F.length(text) >= 30) & F.contains(
            F.lower(collapse(F.col("body_text"))), F.lower(F.substring(text, 1, 120))
        )
        out = F.when(furniture, "semantic").when(
            (word_count(text) < 10) | P.test(text, rf"^(?:{_UI_WORDS})(?:\s+(?:{_UI_WORDS}))*$"), "ui-action"
        )
        for name, pattern in _EXPLAINED:
            out = out.when(P.test(cls, pattern), name)
        return out.when(duplicate, "duplicate").otherwise("unknown")

    return F.transform(
        F.filter(every_element(), hidden),
        lambda e: F.struct(kind(e).alias("kind"), word_count(e["text"]).alias("words")),
    )


def folded_words() -> Column:
    """Words in closed accordions and tabs."""
    nodes = every_element()
    tab_lists = F.filter(F.col("nodes"), lambda e: attr_or(e, "role") == "tablist")

    def folded(e: Column) -> Column:
        after_tabs = F.exists(tab_lists, lambda t: (t["up"] == e["up"]) & (t["last"] < e["ord"]))
        none = style_has(e, "display:none")
        return (
            (attr_or(e, "aria-expanded") == "false")
            | ((attr_or(e, "role") == "tabpanel") & has(e, "hidden"))
            | (has(e, "hidden") & after_tabs)
            | ((e["tag"] == "details") & ~has(e, "open"))
            | (none & attr_or(e, "class").rlike("accordion|tab|collapse"))
        )

    return words_of(F.filter(nodes, folded))


def hidden_keyword_blocks() -> Column:
    """CSS-hidden elements with promotional wording."""
    marks = (
        "display:none", "display: none", "visibility:hidden", "visibility: hidden", "opacity:0", "opacity: 0",
        "font-size:0", "font-size: 0", "text-indent:-",
    )
    hidden = lambda e: style_has(e, *marks) | (style_has(e, "position:absolute") & style_has(e, "left:-"))
    spam = r"\b(best|cheap|top|near me|casino|loan|viagra|crypto|forex|escort|betting)\b"
    return n(every_element(), lambda e: hidden(e) & P.test(e["text"], spam))


def is_empty_shell() -> Column:
    """H13."""
    roots = n(
        F.col("nodes"), lambda e: attr_or(e, "id").isin("root", "__next", "app") | has(e, "data-reactroot")
    )
    meaningful = tag_total("h1", "h2", "p", "article", "section", "main", "li")
    return (F.col("visible_words") < 80) & (roots > 0) & (n(F.col("scripts"), lambda s: has(s, "src")) >= meaningful)


def label_stats() -> Column:
    """Interactive controls and how many carry a label."""
    roles = ("button", "link", "checkbox", "switch", "combobox", "textbox")
    candidates = F.concat(F.col("nodes"), F.col("anchors"))
    fors = F.transform(tagged(F.col("nodes"), "label"), lambda e: attr_or(e, "for"))

    def shown(e: Column) -> Column:
        control = e["tag"].isin("button", "input", "select", "textarea") | attr_or(e, "role").isin(*roles)
        squeezed = F.regexp_replace(F.lower(attr_or(e, "style")), " ", "")
        off = has(e, "hidden") | (attr_or(e, "aria-hidden") == "true") | has(e, "disabled")
        return control & ~off & (F.lower(attr_or(e, "type")) != "hidden") & ~F.contains(squeezed, F.lit("display:none"))

    def labelled(e: Column) -> Column:
        named = F.lit(False)
        for name in ("aria-label", "aria-labelledby", "placeholder", "title"):
            named = named | has_text_attr(e, name)
        return named | (trim_blank(text_or_empty(e["text"])) != "") | (
            has_text_attr(e, "id") & F.array_contains(fors, attr_or(e, "id"))
        )

    controls = F.filter(candidates, shown)
    return F.struct(F.size(controls).alias("total"), n(controls, labelled).alias("labelled"))


# --- scripts ------------------------------------------------------------------------------------


def inline_script_text() -> Column:
    """H15."""
    return F.array_join(texts(F.filter(F.col("scripts"), lambda s: ~has(s, "src"))), "\n")


_LEAVES = r"(location\.(href|assign|replace)|window\.location|document\.location)"
# Script wordings looked for.
HISTORY_TRAPS = (
    r"popstate[\s\S]{0,180}" + _LEAVES,
    r"onpopstate[\s\S]{0,180}" + _LEAVES,
    r"(pushState|replaceState)[\s\S]{0,120}(setInterval|while\s*\(|for\s*\()",
    r"(setInterval|while\s*\(|for\s*\()[\s\S]{0,120}(pushState|replaceState)",
)
EXIT_TRAPS = (
    r"(?:mouseleave|mouseout)[\s\S]{0,220}" + _LEAVES,
    r"(?:beforeunload|unload)[\s\S]{0,220}" + _LEAVES,
)
YIELDING = (
    r"(requestIdleCallback|scheduler\.postTask|requestAnimationFrame|setTimeout\s*\([^,]+,\s*0|await\s+new\s+Promise)"
)
INJECTS_ABOVE = r"(insertBefore|prepend|afterbegin|before\s*\()"
INTERSTITIAL = r"(?:interstitial|full[-\s]?screen\s+(?:modal|popup)|age[-\s]?gate|subscribe[-\s]?overlay)"


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | P.test(text, pattern)
    return out


def head_blocking() -> Column:
    """Scripts of the head that block rendering."""
    return n(
        F.col("scripts"),
        lambda s: inside(s, "head") & has(s, "src") & ~has(s, "async") & ~has(s, "defer")
        & (attr_or(s, "type") != "module"),
    )


def third_party_scripts(site: Column) -> Column:
    """Scripts from another site, with their deferred flag."""
    other = F.filter(
        F.col("scripts"), lambda s: (text_or_empty(s["abs"]) != "") & (s["host"] != site)
    )
    return F.transform(
        other, lambda s: has(s, "async") | has(s, "defer") | (F.lower(attr_or(s, "type")) == "module")
    )


def ad_slots_reserved() -> Column:
    """Every ad-like element keeps room for itself. ``[id*='ad']`` also hits ids like header."""
    el = every_element()
    ad = lambda e: F.contains(attr_or(e, "id"), F.lit("ad")) | attr_or(e, "class").rlike("ad-|ads")
    return F.forall(F.filter(el, ad), lambda e: F.lower(attr_or(e, "style")).rlike("height|aspect-ratio"))


def api_urls(origin: Column) -> Column:
    """Public API addresses in links, scripts and page text."""
    linked = F.filter(
        F.array_sort(F.concat(hrefs(), F.filter(F.col("scripts"), lambda s: has(s, "src"))), lambda a, b: a["ord"] - b["ord"]),
        lambda e: P.test(F.coalesce(attr(e, "href"), attr(e, "src")), r"/(api|wp-json|graphql)(/|$|\?)"),
    )
    written = P.find_all(F.col("html"), r"[\"'(](/(?:api|wp-json|graphql)[^\"'()\s]*)")
    resolved = F.concat(F.transform(linked, lambda e: e["abs"]), F.transform(written, lambda p: F.concat(origin, p)))
    return F.array_distinct(F.filter(resolved, lambda u: u != ""))


def subdomain_hosts(own: Column) -> Column:
    """Hosts below the site's own host."""
    el = F.concat(F.col("anchors"), F.col("images"), F.col("scripts"), F.col("link_tags"), F.col("nodes"))
    hosts = F.transform(F.filter(el, lambda e: e["host"].isNotNull()), lambda e: e["host"])
    return F.array_distinct(F.filter(hosts, lambda h: (h != own) & h.endswith(F.concat(F.lit("."), own))))


# --- embedded local data ------------------------------------------------------------------------

LOCAL_TYPES = (
    "LocalBusiness", "MedicalBusiness", "HealthAndBeautyBusiness", "BeautySalon", "MedicalClinic",
    "ProfessionalService", "Dermatology", "Dentist", "Physician",
)


def local_nodes() -> Column:
    """Microdata and RDFa elements of a local-business type."""
    types = "|".join(LOCAL_TYPES)
    return F.filter(
        F.col("nodes"),
        lambda e: (has(e, "itemscope") & P.test(attr(e, "itemtype"), f"schema\\.org/({types})", ""))
        | P.test(attr(e, "typeof"), rf"(?:^|\s)({types})(?:\s|$)", ""),
    )


def _is_property(e: Column, *names: str) -> Column:
    wanted = [*names, *[f"schema:{name}" for name in names]]
    return attr_or(e, "itemprop").isin(*names) | attr_or(e, "property").isin(*wanted)


def local_property(*names: str) -> Column:
    """Some local element is, or contains, the property."""
    el = F.concat(F.col("nodes"), F.col("anchors"), F.col("metas"), F.col("headings"))
    hits = F.filter(el, lambda e: _is_property(e, *names))
    return F.exists(
        local_nodes(), lambda o: F.exists(hits, lambda i: contains_element(o, i) | (i["ord"] == o["ord"]))
    )


def local_property_text(*names: str) -> Column:
    el = F.concat(F.col("nodes"), F.col("anchors"), F.col("metas"), F.col("headings"))
    inside_local = F.filter(
        el, lambda e: _is_property(e, *names) & F.exists(local_nodes(), lambda o: contains_element(o, e))
    )
    return F.array_join(
        F.transform(inside_local, lambda e: F.coalesce(attr(e, "content"), e["text"], F.lit(""))), " "
    )


def map_signals() -> Column:
    """Map embeds and coordinate wordings."""
    map_host = r"maps\.google|google\.com/maps"
    frames = F.filter(F.col("nodes"), lambda e: (e["tag"] == "iframe") & P.test(attr(e, "src"), map_host, ""))
    links = F.filter(F.col("anchors"), lambda e: P.test(attr(e, "href"), map_host, ""))
    embed = (F.size(frames) > 0) | (F.size(links) > 0)
    html = F.col("html")
    pair = P.test(html, r"(-?\d{1,2}\.\d{3,})\s*,\s*(-?\d{1,3}\.\d{3,})", "")
    google = P.test(html, r"!3d(-?\d{1,2}\.\d+)!4d(-?\d{1,3}\.\d+)", "")
    return F.struct(
        embed.alias("embed"),
        (embed | pair | google | P.test(html, r"\b(latitude|lat)\b[\"'\s:=]+(-?\d{1,2}\.\d+)")).alias("latitude"),
        (embed | pair | google | P.test(html, r"\b(longitude|lng|lon)\b[\"'\s:=]+(-?\d{1,3}\.\d+)")).alias("longitude"),
    )


# --- named texts --------------------------------------------------------------------------------


def breadcrumb_texts() -> Column:
    """Link and span texts below breadcrumb-like elements."""
    el = F.array_sort(F.concat(F.col("anchors"), tagged(F.col("nodes"), "span")), lambda a, b: a["ord"] - b["ord"])
    hits = F.transform(F.filter(el, lambda e: e["crumb"]), lambda e: collapse(e["text"]))
    return F.filter(hits, lambda t: t != "")


def footer_text() -> Column:
    """Footer elements, else elements named like one."""
    own = collapse(joined(tagged(F.col("nodes"), "footer"), ""))
    named = F.filter(
        F.col("nodes"),
        lambda e: P.test(F.concat_ws("\n", attr(e, "class"), attr(e, "id")), "footer"),
    )
    return F.when(own != "", own).otherwise(collapse(joined(named, "")))


def has_byline() -> Column:
    """H22."""
    el = every_element()
    marked = F.exists(el, lambda e: (attr_or(e, "rel") == "author") | P.test(attr(e, "class"), "author|byline"))
    return marked | P.test(F.col("body_text"), r"\b(by|written by|reviewed by)\s+[A-Z][a-z]+")


def bio_link(site: Column) -> Column:
    """H22."""
    return first(
        internal_links(site),
        lambda a: P.test(F.concat_ws(" ", a["abs"], trim_blank(text_or_empty(a["text"]))), "author|team|about|bio|profile"),
    )


def answer_sections() -> Column:
    """Second-level sections with their words and whether they read like an answer."""
    verbs = r"\b(is|are|means|includes|helps|use|should|can|will|because|for example)\b"
    return F.transform(
        F.col("h2_sections"),
        lambda s: F.struct(
            s["title"].alias("title"),
            word_count(s["text"]).alias("words"),
            ((word_count(s["text"]) >= 40) & P.test(s["text"], verbs)).alias("answer_like"),
        ),
    )


def product_service_text() -> Column:
    """Text of elements named after offers, once per selector that hits."""
    el = every_element()
    named = lambda key, word: F.filter(el, lambda e: F.contains(attr_or(e, key), F.lit(word)))
    words = ("service", "product", "treatment", "solution")
    return F.concat_ws(" ", *[joined(named(key, word), "") for word in words for key in ("class", "id")])


def navigation_text() -> Column:
    """Link and button texts of navigation and header."""
    el = F.array_sort(F.concat(F.col("anchors"), tagged(F.col("nodes"), "button")), lambda a, b: a["ord"] - b["ord"])
    return joined(F.filter(el, lambda e: e["up"].rlike("/(nav|header)/")), " ")
