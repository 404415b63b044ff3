"""Fields of pages by class names and attributes: contacts, listing cards, pagination, scrolling, RDFa, scores.

Contacts, headlines, cards and RDFa are read from the table of elements, so texts are
those of whole elements and comments and scripts hide what they hold. Pagination,
endless scrolling and the scores are column expressions over the markup itself, in
which an element is found by its opening tag and its text runs to its next tag.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import text as tx
from loomery.functions import urls
from loomery.operators import markup

#: Classes and hosts that mark contacts.
EMAIL_CLASSES, PHONE_CLASSES = ("email", "e-mail"), ("phone", "telephone", "tel")
ADDRESS_CLASSES = ("address", "location", "contact-address", "office-address")
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com")
PHONES = (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\(\d{3}\)\s*\d{3}[-.]?\d{4}", r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}")
#: Classes and words that tell endless pages.
LOADING_CLASSES = ("loading", "spinner", "loader", "infinite-loading", "load-indicator")
FEED_CLASSES = ("feed", "timeline", "infinite-scroll", "results-container", "items-container")
SCROLL_WORDS = ("infinite", "scroll", "lazy", "load-more", "IntersectionObserver", "onscroll")
#: Words that speak for a kind of page, weight of each, their cap.
NEWS_WORDS = ("article", "news", "story", "headline", "byline", "publish", "author", "content", "journalism")
SHOP_WORDS = ("product", "price", "cart", "buy", "shop", "store", "catalog", "category", "checkout")
SEMANTIC_TAGS = ("header", "nav", "main", "article", "section", "aside", "footer")


def _opening(classes: Sequence[str]) -> str:
    names = "|".join(map(re.escape, classes))
    return rf"""<[a-zA-Z][a-zA-Z0-9]*\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:{names})(?:\s[^"']*)?["'][^>]*>"""


def texts_of(html: Column, classes: Sequence[str]) -> Column:
    """Trimmed texts of all elements of these classes, empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(rf"{_opening(classes)}([^<]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def has_class(html: Column, classes: Sequence[str]) -> Column:
    return html.rlike(_opening(classes))


def attributes_of(html: Column, name: str, start: str = "") -> Column:
    """Values of an attribute that begin with ``start``, without it."""
    return F.regexp_extract_all(html, F.lit(rf"""<[^>]*\s{re.escape(name)}\s*=\s*["']{re.escape(start)}([^"']+)["']"""), F.lit(1))


def _attribute(name: str, start: str = "") -> Column:
    """The attribute's value without ``start``, or null where it begins otherwise or is empty."""
    value = F.col("attributes")[name]
    return F.when(value.startswith(start), F.nullif(F.substring(value, len(start) + 1, 1 << 30), F.lit("")))


def _of_class(classes: Sequence[str]) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, classes)))


def contacts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, emails, phones, addresses, social_links, contact_forms): distinct, sorted; from links, attributes, classes and visible text."""
    nodes = markup.element_table(pages, key, html)
    anchors = F.when(F.col("tag") == "a", _attribute("href"))
    form = (F.col("tag") == "form") & (F.coalesce(_attribute("action"), F.lit("")).contains("contact") | F.coalesce(_attribute("id"), F.lit("")).contains("contact"))
    stated = F.array(
        *[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in (
            ("emails", F.substring_index(_attribute("href", "mailto:"), "?", 1)), ("emails", _attribute("data-email")), ("phones", _attribute("href", "tel:")),
            ("phones", _attribute("data-phone")), ("phones", _attribute("data-tel")), ("social_links", F.when(tx.has_any(anchors, SOCIAL_HOSTS), anchors)), ("forms", F.when(form, F.col("pre").cast("string"))),
        )]
    )
    texts = markup.class_texts(nodes, key, {"emails": EMAIL_CLASSES, "phones": PHONE_CLASSES, "addresses": ADDRESS_CLASSES})
    visible = tx.without_scripts(F.col(f"`{html}`"))
    found = nodes.select(key, F.explode(stated).alias("x")).select(key, "x.*").unionByName(texts.select(key, F.col("field").alias("kind"), F.col("text").alias("value")))
    for kind, pattern in (("emails", tx.PATTERNS["email"]), *(("phones", p) for p in PHONES)):
        found = found.unionByName(pages.select(F.col(key), F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(visible, F.lit(pattern), F.lit(0))).alias("value")))
    kinds = ("emails", "phones", "addresses", "social_links")
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds]
    summed = found.where("value <> ''").groupBy(key).agg(*lists, F.count_if(F.col("kind") == "forms").alias("contact_forms"))
    none = F.array().cast("array<string>")
    return pages.select(key).join(summed, key, "left").select(key, *[F.coalesce(k, none).alias(k) for k in kinds], F.coalesce("contact_forms", F.lit(0)).cast("int").alias("contact_forms"))


def headline_contacts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title, phone, email): first heading, else the page title, as whole texts; first telephone and mail link."""
    nodes = markup.element_table(pages, key, html)
    texts = markup.with_text(nodes.where("tag IN ('h1', 'title')"), nodes, key).where("text <> ''")
    heads = texts.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("tag") == "h1", F.col("text")), F.when(F.col("tag") == "h1", F.col("pre"))), F.min_by(F.when(F.col("tag") == "title", F.col("text")), F.when(F.col("tag") == "title", F.col("pre")))).alias("title"))
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("pre")))
    links = nodes.groupBy(key).agg(first(_attribute("href", "tel:")).alias("phone"), first(_attribute("href", "mailto:")).alias("email"))
    return links.join(heads, key, "left").select(key, "title", "phone", "email")


def cards(pages: DataFrame, key: str, classes: Sequence[str], fields: Mapping[str, Sequence[str]], html: str = "html", most: int = 50) -> DataFrame:
    """(key, pos, link, shown_at, one column per field): listing cards of one page, at most ``most`` in page order, as a selector table asks.

    A field is the whole text of the first element of its classes within the card;
    ``link`` and ``shown_at`` are the first link target and datetime inside. Shops,
    directories, news lists, feeds and search results differ only in their classes.
    """
    nodes = markup.element_table(pages, key, html)
    order = Window.partitionBy(key).orderBy("pre")
    held = nodes.where(_of_class(classes)).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)
    marks = {"link": (F.col("tag") == "a") & _attribute("href").isNotNull(), "shown_at": _attribute("datetime").isNotNull(), **{f"field_{n}": _of_class(names) for n, names in enumerate(fields.values())}}
    parts = markup.parts_inside(nodes, held, key, marks)
    # One row for each part that a card has, with its text or attribute.
    each = parts.select(key, "c_pre", F.explode(F.array(*[F.struct(F.lit(m).alias("part"), F.col(m).alias("pre")) for m in marks])).alias("x")).select(key, "c_pre", "x.*").where("pre IS NOT NULL")
    known = markup.with_text(nodes.join(each.select(key, "pre").distinct(), [key, "pre"], "left_semi"), nodes, key).select(key, "pre", "text", _attribute("href").alias("href"), _attribute("datetime").alias("datetime"))
    value = F.when(F.col("part") == "link", F.col("href")).when(F.col("part") == "shown_at", F.col("datetime")).otherwise(F.nullif("text", F.lit("")))
    met = each.join(known, [key, "pre"]).withColumn("value", value)
    of = lambda m: F.max(F.when(F.col("part") == m, F.col("value")))
    wide = met.groupBy(key, F.col("c_pre").alias("pre")).agg(of("link").alias("link"), of("shown_at").alias("shown_at"), *[of(f"field_{n}").alias(name) for n, name in enumerate(fields)])
    return held.select(key, "pre", F.col("place").alias("pos")).join(wide, [key, "pre"], "left").select(key, "pos", "link", "shown_at", *fields)


def pagination(html: Column, url: Column) -> Column:
    """struct(kind, next_url, pages, current, total): next links outrank page numbers, a load-more button both; "of N" in the pager's text gives the total."""
    rel = F.regexp_extract(html, r"""<a\b[^>]*\brel\s*=\s*["']next["'][^>]*>""", 0)
    marked = F.regexp_extract(html, _opening(("next", "next-page")), 0)
    button = F.when(rel != "", rel).when(marked != "", marked)
    href = F.nullif(F.regexp_extract(button, r"""\bhref\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    pager = F.regexp_extract(html, rf"(?s){_opening(('pagination', 'page-numbers', 'pager'))}(.*?)</(?:div|nav|ul)>", 1)
    numbers = tx.hrefs(pager)
    current = F.get(texts_of(html, ("current", "active")), 0)
    of = F.regexp_extract(tx.without_scripts(pager), r"of (\d+)", 1)
    more = has_class(html, ("load-more", "show-more"))
    kind = F.when(more, "load_more").when(button.isNotNull(), "next_button").when(F.size(numbers) > 0, "numbered_pages").otherwise("none")
    total = F.when(of != "", of.cast("int")).when(F.size(numbers) > 0, F.size(numbers)).otherwise(1)
    return F.struct(kind.alias("kind"), F.when(href.isNotNull(), urls.resolve_link(url, href)).alias("next_url"), F.size(numbers).alias("pages"), F.when(current.rlike(r"^\d+$"), current.cast("int")).otherwise(1).alias("current"), total.alias("total"))


def endless(html: Column) -> Column:
    """struct(endless, loading, feeds): loading marks, feed containers, and words of scripts that load while scrolling."""
    held = lambda names: F.array_compact(F.array(*[F.when(has_class(html, (n,)), F.lit(n)) for n in names]))
    loading = held(LOADING_CLASSES)
    return F.struct(((F.size(loading) > 0) | tx.has_any(html, SCROLL_WORDS)).alias("endless"), loading.alias("loading"), held(FEED_CLASSES).alias("feeds"))


def rdfa(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, type, property, value): every property inside each typeof element; content before the whole text; empty ones are left out."""
    nodes = markup.element_table(pages, key, html)
    order = Window.partitionBy(key).orderBy("pre")
    typed = nodes.where(F.col("attributes")["typeof"].isNotNull()).select(key, F.col("pre").alias("c_pre"), F.col("last").alias("c_last"), F.substring_index(F.col("attributes")["typeof"], "/", -1).alias("type"), (F.row_number().over(order) - 1).alias("pos"))
    marked = nodes.where(F.length(F.col("attributes")["property"]) > 0)
    texts = markup.with_text(marked, nodes, key).select(key, "pre", F.col("attributes")["property"].alias("property"), F.coalesce(_attribute("content"), F.nullif("solid", F.lit(""))).alias("value"))
    return markup.descendants(typed, texts, key).where("value IS NOT NULL").select(key, "pos", "type", "property", "value")


def element_counts(pages: DataFrame, key: str, html: str = "html", least: int = 3) -> DataFrame:
    """(key, selector, n): tag and classes that ``least`` elements of a page share."""
    nodes = markup.element_table(pages, key, html, keep=False).where("size(classes) > 0")
    selector = F.concat("tag", F.lit("."), F.array_join(F.array_sort("classes"), "."))
    return nodes.groupBy(key, selector.alias("selector")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def accessibility(html: Column) -> Column:
    """Score of at most 1 from alternative texts by images, ARIA attributes, semantic tags and headings."""
    low = F.lower(html)
    images, aria = _count(low, "<img"), _count(low, "aria-")
    tags = sum((low.contains(f"<{t}").cast("int") for t in SEMANTIC_TAGS), F.lit(0))
    heads = tx.has_any(low, [f"<h{i}" for i in range(1, 7)])
    score = F.when(images > 0, _count(low, "alt=") / images * 0.3).otherwise(0.3) + F.least(F.lit(0.2), aria / 20) + F.least(F.lit(0.3), tags / len(SEMANTIC_TAGS) * 0.3) + F.when(heads, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def _page_score(html: Column, words: Sequence[str], weight: float, cap: float, base: float, *bonus: tuple[Column, float]) -> Column:
    low = F.lower(html)
    found = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    score = F.lit(base) + F.least(found * weight, F.lit(cap))
    for test, value in bonus:
        score = score + F.when(test, value).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def news_score(html: Column) -> Column:
    return _page_score(html, NEWS_WORDS, 0.08, 0.4, 0.2, (html.contains("Article") & html.contains("application/ld+json"), 0.3), (html.rlike(r"<time\b|<[^>]*\sdatetime\s*="), 0.1))


def shop_score(html: Column) -> Column:
    return _page_score(html, SHOP_WORDS, 0.1, 0.5, 0.2, (html.rlike(r"""\bclass\s*=\s*["'][^"']*price|<[^>]*\sdata-price\b"""), 0.2), (html.contains("application/ld+json") & html.contains("Product"), 0.2))


def entity_confidence(text: Column, kind: Column, context: Column) -> Column:
    """Confidence of a found price, email, phone, date or other entity; a tenth more if its kind stands in the context."""
    price = 0.7 + F.when(text.rlike("[$€£]"), 0.2).otherwise(0.0) - F.when(text.rlike(r"^\d{7,}$"), 0.3).otherwise(0.0)
    phone = 0.7 + F.when(text.rlike(r"[-() ]"), 0.1).otherwise(0.0)
    date = 0.7 + F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), 0.2).otherwise(0.0)
    base = F.when(kind == "price", price).when(kind == "email", F.lit(0.95)).when(kind == "phone", phone).when(kind == "date", date).otherwise(0.7)
    return F.least(base + F.when(F.contains(F.lower(context), kind), 0.1).otherwise(0.0), F.lit(1.0))


def url_validation(url: Column) -> Column:
    """struct(valid, url, domain, scheme, errors, warnings); a missing scheme becomes https."""
    trimmed = F.trim(url)
    given = urls.scheme(trimmed) != ""
    whole = F.when(given, trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    kind, name = urls.scheme(whole), urls.netloc(whole)
    label = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    errors = F.array_compact(F.array(F.when(~kind.isin("http", "https"), F.concat(F.lit("Invalid scheme: "), kind)), F.when(name == "", "Missing domain").when(~F.substring_index(name, ":", 1).rlike(rf"^{label}(?:\.{label})*$"), "Invalid domain format")))
    normal = urls.normalize(whole)
    warnings = F.array_compact(F.array(F.when(~given, "Added missing https:// scheme"), F.when(urls.is_false_positive(normal), "URL appears to be a false positive")))
    empty = F.coalesce(url, F.lit("")) == ""
    none = F.array().cast("array<string>")
    return F.struct(
        (~empty & (F.size(errors) == 0)).alias("valid"), F.when(empty, url).otherwise(normal).alias("url"), F.when(empty, "").otherwise(name).alias("domain"), F.when(empty, "").otherwise(kind).alias("scheme"),
        F.when(empty, F.array(F.lit("URL must be a non-empty string"))).otherwise(errors).alias("errors"), F.when(empty, none).otherwise(warnings).alias("warnings"),
    )


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, three where the last two are a short country suffix such as co.uk."""
    name = F.regexp_replace(urls.host(url), r":\d+$|^.*@", "")
    short = r"(?:^|\.)((?:[^.]+\.)(?:co|com|org|net|gov|ac|edu)\.[a-z]{2})$"
    return F.when(name.rlike(short), F.regexp_extract(name, short, 1)).otherwise(F.substring_index(name, ".", -2))


#: Words and hosts that speak for directories and social pages; marks of captchas; names of form fields, first match wins.
DIRECTORY_WORDS = ("listing", "business", "directory", "search-result", "card", "item", "result")
PROFILE_HOSTS = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com")
PROFILE_WORDS = ("profile", "bio", "followers", "connections", "about")
CAPTCHAS = {
    "recaptcha": r"""\bclass\s*=\s*["'][^"']*\bg-recaptcha\b|\sdata-sitekey\b|<iframe\b[^>]*\bsrc\s*=\s*["'][^"']*recaptcha|\bid\s*=\s*["']recaptcha["']""",
    "hcaptcha": r"""\bclass\s*=\s*["'][^"']*\bh-captcha\b|\sdata-sitekey\s*=\s*["'][^"']*hcaptcha|<iframe\b[^>]*\bsrc\s*=\s*["'][^"']*hcaptcha""",
    "image_captcha": r"""\bclass\s*=\s*["'][^"']*\b(?:captcha-image|verification-image)\b|\s(?:src|alt)\s*=\s*["'][^"']*captcha""",
    "text_captcha": r"""\bclass\s*=\s*["'][^"']*\bcaptcha-input\b|\s(?:name|placeholder)\s*=\s*["'][^"']*captcha""",
}
FIELD_NAMES = {
    "email": ("email", "e-mail", "mail", "user_email", "contact_email"),
    "name": ("name", "full_name", "first_name", "last_name", "username", "contact_name"),
    "phone": ("phone", "telephone", "mobile", "contact_phone", "phone_number"),
    "company": ("company", "organization", "business", "company_name"),
    "message": ("message", "comment", "inquiry", "question", "description"),
}


def directory_score(html: Column) -> Column:
    names = F.regexp_count(html, F.lit(r"""(?i)<h[123]\b|<[a-z][a-z0-9]*\b[^>]*\bclass\s*=\s*["'][^"']*\b(?:business-name|company-name)\b"""))
    phones = F.regexp_count(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']tel:"""))
    return _page_score(html, DIRECTORY_WORDS, 0.1, 0.4, 0.3, (names > 3, 0.2), (phones > 2, 0.1))


def social_score(url: Column, html: Column) -> Column:
    return _page_score(html, PROFILE_WORDS, 0.1, 0.3, 0.3, (tx.has_any(url, PROFILE_HOSTS), 0.4))


def structured_score(html: Column, purpose: Column) -> Column:
    marks = [("application/ld+json", 0.2), ("itemtype", 0.1), ("typeof", 0.1)]
    return _page_score(html, (), 0.0, 0.0, 0.5, *[(html.contains(m), v) for m, v in marks], (purpose.isin("product_data", "company_info", "news_content"), 0.1))


def cluster_score(sections: Column) -> Column:
    """Confidence that a page of so many long sections can be clustered."""
    return F.when(sections >= 10, 0.9).when(sections >= 5, 0.8).when(sections >= 2, 0.6).otherwise(0.3)


def captchas(html: Column) -> Column:
    """Labels of the captchas that a page shows; they are only told, never solved."""
    return F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), name) for name, p in CAPTCHAS.items()]))


def page_quality(html: Column) -> Column:
    """struct of five scores from 0 to 1: length, structured data, title and descriptions, links, forms."""
    f = tx.structural_features(html)
    meta = F.when(tx.title(html) != "", 0.4).otherwise(0.0) + F.when(html.rlike(r"""(?i)<meta\b[^>]*\bname\s*=\s*["']description["']"""), 0.3).otherwise(0.0) + F.when(html.rlike(r"""(?i)<meta\b[^>]*\bproperty\s*=\s*["']og:"""), 0.3).otherwise(0.0)
    share = lambda n, full: F.least(n / full, F.lit(1.0))
    return F.struct(
        share(F.length(html), 10000).alias("length"), F.when(f["has_json_ld"] | f["has_microdata"], 1.0).otherwise(0.0).alias("structured"), meta.alias("meta"),
        share(f["link_count"], 50).alias("links"), F.when(f["form_count"] > 0, share(f["form_count"], 5)).otherwise(0.5).alias("forms"),
    )


def field_purpose(texts: Column, kind: Column, tag: Column) -> Column:
    """What a form field asks for: by its name, id, placeholder and label together, else by its type or tag."""
    low, out = F.lower(texts), None
    for name, words in FIELD_NAMES.items():
        out = F.when(tx.has_any(low, words), name) if out is None else out.when(tx.has_any(low, words), name)
    return out.when(kind == "email", "email").when(kind == "tel", "phone").when(kind == "password", "password").when(tag == "textarea", "message").otherwise("unknown")


def structural_similarity(a: Column, b: Column) -> Column:
    """Of two struct(tag, classes, children, length): 0 for different tags, else the mean of 1, class overlap and ratios of children and text length where either has any."""
    classes = F.when((F.size(a["classes"]) > 0) | (F.size(b["classes"]) > 0), F.size(F.array_intersect(a["classes"], b["classes"])) / F.size(F.array_union(a["classes"], b["classes"])))
    ratio = lambda c: F.when(F.greatest(a[c], b[c]) > 0, 1 - F.abs(a[c] - b[c]) / F.greatest(a[c], b[c]))
    parts = F.array_compact(F.array(F.lit(1.0), classes, ratio("children"), ratio("length")))
    return F.when(a["tag"] == b["tag"], F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(0.0)


def relation(kind: Column, other: Column, gap: Column) -> Column:
    """How an element of one type relates to a later one: product_to_price, article_to_author, or null."""
    return F.when(kind.isin("text", "name") & (other == "price"), "product_to_price").when((kind == "text") & (other == "name") & (F.abs(gap) < 100), "article_to_author")


def success_indicators(fields: Column) -> Column:
    """Labels of what speaks for a good extraction: many fields of a map, contacts, a long text."""
    contact = F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, ("email", "phone", "address", "contact_email", "telephone"))))
    return F.array_compact(F.array(F.when(F.size(fields) >= 5, "high_field_count"), F.when(contact, "contact_info_present"), F.when(F.exists(F.map_values(fields), lambda v: F.length(v) > 50), "detailed_text_content")))
