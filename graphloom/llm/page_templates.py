"""Generated pages with known labels, to train and test the block labeller on: articles among furniture, in many layouts."""

from __future__ import annotations

import numpy as np

#: Names that class, id and role attributes give to parts of a page, and words that such parts tend to hold.
FURNITURE = {
    "menu": ("nav ul div", "menu nav navigation navbar breadcrumb breadcrumbs topbar toolbar pagination pager links skip toc tabs", "home about contact menu next previous products services news archive more start inicio accueil"),
    "header": ("header div", "header masthead branding logo top site hero head", "welcome site blog magazine daily search login"),
    "footer": ("footer div", "footer foot copyright colophon legal bottom imprint credits", "© copyright rights reserved privacy terms imprint impressum datenschutz mentions légales aviso"),
    "sidebar": ("aside div section", "sidebar aside side rail widget widgets related recommended popular trending recent tags share social sharing follow secondary complementary", "related popular share follow tags recent posts more like this"),
    "notice": ("div section dialog", "notice notices cookie cookies consent gdpr alert warning popup modal overlay announcement paywall disclaimer message status", "cookies accept consent website uses agree browser javascript enable privacy policy notice"),
    "advert": ("div aside section", "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner commercial", "advertisement sponsored anzeige publicité publicidad buy now offer"),
    "form": ("form div", "form search newsletter subscribe subscription signup login register contact feedback", "subscribe email address name send submit search password sign up newsletter"),
    "comments": ("section div ol ul", "comment comments commentlist reply replies respond disqus discussion thread reviews responses", "comment comments reply said wrote posted great thanks"),
}
CONTENT_TAGS = "article main div section".split()
CONTENT_NAMES = "article content main post entry story text body prose single news blog markdown".split()
NEUTRAL = "wrapper container page layout row col column grid inner outer box block wrap app root site left center".split()
LEAVES = ["p"] * 12 + "h1 h2 h3 li li blockquote pre td dd figcaption div".split()
SYLLABLES = "a an ar ba be bo ca ce chi da de di do du e el en er es fa fi ga ge ha he ho i in is ka ke la le li lo lu ma me mi mo na ne ni no nu o on or pa pe po qua ra re ri ro ru sa se si so ta te ti to tu u un ur va ve vi wa we yo za".split()


def _prose(rng: np.random.Generator, words: int) -> str:
    out, start = [], True
    syllables, sizes, chances, signs = rng.integers(0, len(SYLLABLES), 3 * words).tolist(), rng.integers(1, 4, words).tolist(), rng.random(words).tolist(), rng.integers(0, 6, words).tolist()
    for i in range(words):
        w = "".join([SYLLABLES[k] for k in syllables[3 * i : 3 * i + sizes[i]]])
        out.append(w.capitalize() if start else w)
        start = chances[i] < 0.12
        if start:
            out[-1] += (".", ".", ".", ",", "?", "&amp;")[signs[i]]
    return " ".join(out) + ("." if rng.random() < 0.8 else "")


def _names(rng: np.random.Generator, names: list[str]) -> str:
    picked = list(rng.choice(names, 1 + (rng.random() < 0.3)))
    if rng.random() < 0.3:
        picked.append(str(rng.choice(NEUTRAL)))
    joined = str(rng.choice(["-", "_", " "])).join(picked)
    return f' {rng.choice(["class", "class", "id"])}="{joined}"'


def sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in page order, whether it belongs to the article."""
    if rng.random() < 0.03:  # text without any markup
        return _prose(rng, int(rng.integers(1, 60))), [True]
    out: list[str] = []
    labels: list[bool] = []
    bare = rng.random() < 0.12  # no names and no telling elements at all

    def furniture(kind: str) -> None:
        tags, names, cues = FURNITURE[kind]
        tag = str(rng.choice(tags.split()))
        named = _names(rng, names.split()) if tag in ("div", "section", "ul", "ol", "dialog") or rng.random() < 0.4 else ""
        if bare:
            tag, named = ("form" if kind == "form" else "div" if tag not in ("ul", "ol") else tag), ""
        out.append(f"<{tag}{named}>")
        if rng.random() < 0.3 and not bare:
            heading = str(rng.choice(["h2", "h3", "h4", "h1"] if kind in ("header", "comments", "sidebar") else ["h3", "h4", "p"]))
            out.append(f"<{heading}>{rng.choice(cues.split())} {_prose(rng, int(rng.integers(1, 4)))}</{heading}>")
            labels.append(False)
        for _ in range(int(rng.integers(1, 7))):
            long = kind in ("comments", "notice", "advert", "sidebar") and rng.random() < 0.5
            body = _prose(rng, int(rng.integers(8, 50) if long else rng.integers(1, 6)))
            if rng.random() < (0.9 if bare else 0.4):
                body = f"{rng.choice(cues.split())} {body}"
            if kind in ("menu",) or kind in ("footer", "sidebar", "header") and rng.random() < 0.5:
                body = f'<a href="/{len(out)}">{body}</a>'
            leaf = "li" if tag in ("ul", "ol") or kind == "menu" and rng.random() < 0.5 else str(rng.choice(["p", "div", "span", "p", "label" if kind == "form" else "p"]))
            if kind == "form" and rng.random() < 0.4:
                leaf = str(rng.choice(["button", "legend"]))
            if leaf in ("span", "label"):
                leaf = "div"
            out.append(f"<{leaf}>{body}</{leaf}>")
            labels.append(False)
        out.append(f"</{tag}>")

    def some(chances: dict[str, float]) -> None:
        for kind in rng.permutation(list(chances)):
            if rng.random() < chances[kind]:
                furniture(str(kind))

    def article() -> None:
        title = rng.random()
        inside = rng.random() < 0.15 and not bare
        if title < 0.8:
            out.append(("<header>" if inside else "") + f"<h1>{_prose(rng, int(rng.integers(1, 14)))}</h1>" + ("</header>" if inside else ""))
            labels.append(True)
        for k in range(int(rng.integers(1, 16))):
            leaf = str(rng.choice(LEAVES))
            body = _prose(rng, int(rng.integers(1, 8) if leaf[0] == "h" or rng.random() < 0.15 else rng.integers(6, 70)))
            if rng.random() < 0.15:
                body = f"<b>{body}<br>" if rng.random() < 0.5 else f'{body} <a href="/x">{_prose(rng, 2)}</a>'
            wrap = {"li": ("<ul>", "</ul>"), "td": ("<table><tr>", "</tr></table>"), "dd": ("<dl>", "</dl>"), "figcaption": ("<figure>", "</figure>")}.get(leaf, ("", ""))
            end = "" if leaf == "p" and rng.random() < 0.2 else f"</{leaf}>"
            out.append(f"{wrap[0]}<{leaf}>{body}{end}{wrap[1]}")
            labels.append(True)
            if k and rng.random() < 0.06 and not bare:
                furniture(str(rng.choice(["advert", "sidebar", "notice", "form"])))

    out.append('<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body>')
    opened = []
    if rng.random() < 0.4:
        out.append(f"<div{'' if bare else _names(rng, NEUTRAL)}>")
        opened.append("div")
    some({"menu": 0.6, "header": 0.4, "notice": 0.3, "advert": 0.4, "form": 0.15, "sidebar": 0.15})
    inner = []
    for _ in range(int(rng.integers(0, 3)) if not bare else 0):
        tag = str(rng.choice(CONTENT_TAGS))
        named = _names(rng, CONTENT_NAMES + NEUTRAL[:6]) if tag in ("div", "section") or rng.random() < 0.3 else ""
        out.append(f"<{tag}{named}>")
        inner.append(tag)
    article()
    if inner and rng.random() < 0.25 and not bare:
        some({"comments": 0.5, "sidebar": 0.5, "menu": 0.3, "footer": 0.2})
    out.extend(f"</{t}>" for t in reversed(inner))
    if bare:
        out.append("<hr>")
    some({"comments": 0.0 if bare else 0.3, "sidebar": 0.0 if bare else 0.4, "form": 0.2, "advert": 0.0 if bare else 0.2, "notice": 0.15})
    if rng.random() < 0.7:
        furniture("footer")
    out.extend(f"</{t}>" for t in reversed(opened))
    out.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(out), labels

