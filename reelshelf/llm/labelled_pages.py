"""Small labelled pages that the extraction model is trained on.

An element with the attribute keep is main content with all inside it, one with drop is not; other
elements, and what is outside them, are not. Written for this purpose in the usual layouts of pages.
"""

_LONG = "A long sentence about the matter at hand, with some detail, a comma or two, and a full stop at its end. Then a second one that goes on."
_MORE = "The next part tells more of it. It has several sentences. None of them is a link, and they are plain prose throughout, as articles are."
_SHORT = "A short line of prose."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact"))
_READER = "I read this with interest, and I don't agree with the second part at all. Thanks for writing it anyway."

_LINE = "A line that is not very long, but prose, with a comma."
_TALK = f'<div class="comment"><p>{_READER}</p></div><div class="comment"><p>{_SHORT}</p></div>'

PAGES = [
    f'<html><body><main keep><h1>H</h1><p>{_SHORT}</p><p>Part <a href="/x">two</a> is here.</p><p>{_LINE}</p><section class="comments" drop><p>{_READER}</p><p>{_READER}</p></section></main><footer><p>{_LINE}</p></footer></body></html>',
    f'<html><body><header><h1>Name of the site</h1><p>{_LINE}</p></header><article keep><header><h1>Title</h1></header><p>{_SHORT}</p><form drop><p>{_SHORT}</p></form><p>{_LINE}</p><aside drop><p>{_LINE}</p></aside></article></body></html>',
    f'<html><body><header><p>{_LINE}</p><h2>Site</h2></header><main keep><p>{_LINE}</p><p>{_SHORT}</p><p>{_LONG}</p></main><footer><p>{_SHORT}</p></footer></body></html>',
    f'<html><body><header><div><h1>Site</h1><p>{_LONG}</p></div></header><div class="post" keep><h1>Title</h1><p>{_LONG}</p></div></body></html>',
    f'<html><body><div class="header">Site</div><div class="main" keep><h2>Test</h2><p>{_LINE}</p><div class="comments" drop><p>{_READER}</p></div></div><div class="cookie-banner">We use cookies, ok?</div></body></html>',
    f'<html><body><div id="main" keep><h1>Title</h1><p>{_LINE}</p><p>{_SHORT}</p><p>{_LINE}</p><div class="related" drop><h3>More</h3><ul>{_LINKS}</ul></div><section id="comments" drop><h2>Comments</h2>{_TALK}</section></div><div class="widget">{_LINE}</div></body></html>',
    f'<html><body><article keep><h2>Title</h2><div class="byline" drop>By one</div><p>{_LINE}</p><p>{_LINE}</p><aside drop><p>{_LINE}</p></aside><p>{_SHORT}</p><footer drop><p>{_LINE}</p></footer><div class="comments" drop>{_TALK}{_TALK}</div></article><aside><p>{_LINE}</p><p>{_LONG}</p></aside></body></html>',
    f'<html><body><div class="content" keep><p>{_SHORT}</p><p>{_LINE}</p><p>{_LONG}</p><ol><li>{_LINE}</li><li>{_SHORT}</li></ol><p>{_LINE}</p><form drop><p>{_LINE}</p><button>Go</button></form></div><div class="comments">{_TALK}{_TALK}</div><div class="footer"><p>{_LINE}</p></div></body></html>',
    f'<html><body><div class="story-body" keep><h1>Story</h1><div><p>{_LINE}</p><p>{_LINE}</p></div><div><p>{_SHORT}</p></div><figure><figcaption>{_LINE}</figcaption></figure></div><div class="sponsored"><h3>Buy</h3><p>{_LINE}</p></div><nav><ul>{_LINKS}</ul></nav></body></html>',
    f'<html><head><title>T</title></head><body><nav><ul>{_LINKS}</ul></nav><div class="ad">{_SHORT}</div><article keep><h1>A title</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p></article><footer>&copy; Site. {_SHORT}</footer></body></html>',
    f'<html><body><header><h1><a href="/">Site</a></h1><ul class="menu">{_LINKS}</ul></header><main><article keep><header><h1>Title of it</h1></header><p>{_MORE}</p><h2>Part</h2><p>{_LONG}</p><ul><li>One thing of note</li><li>Another thing</li></ul></article><aside class="sidebar"><h3>Related</h3><ul>{_LINKS}</ul><p>{_SHORT}</p></aside></main><footer><p>{_SHORT}</p></footer></body></html>',
    f'<html><body><div id="header"><div class="logo">Site</div><div class="nav">{_LINKS}</div></div><div id="content" keep><h1>Words</h1><div class="text"><p>{_LONG}</p><p>{_LONG}</p></div></div><div id="sidebar"><p>{_LONG}</p><ul>{_LINKS}</ul></div><div id="footer">{_SHORT}</div></body></html>',
    f'<html><body><div class="cookie-notice"><p>We use cookies to make this site better. Do you accept them? Read our policy.</p><button>Accept</button></div><div class="wrapper"><div class="post" keep><h1>On a thing</h1><p>{_MORE}</p><blockquote><p>{_SHORT}</p></blockquote><p>{_LONG}</p></div><section class="comments"><h2>Comments</h2><div class="comment"><p>{_READER}</p></div><div class="comment"><p>{_READER}</p><p>{_SHORT}</p></div></section></div><footer>{_SHORT}</footer></body></html>',
    f'<html><body><nav>{_LINKS}</nav><div class="page"><div class="entry" keep><h2>Entry</h2><p>{_LONG}</p><p>{_LONG}</p><div class="share" drop><a href="/s">Share</a> <a href="/t">Send</a></div><p>{_MORE}</p></div><form class="subscribe"><label>Your mail</label><p>{_SHORT}</p><button>Send</button></form><div class="related"><h3>More</h3>{_LINKS}</div></div><div class="footer"><p>{_LONG}</p></div></body></html>',
    f'<html><body><div><ul>{_LINKS}</ul></div><div keep><h1>Plain</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></div><div><ul>{_LINKS}</ul></div><div><a href="/p">Privacy</a> <a href="/q">Terms</a></div></body></html>',
    f'<html><body><div class="banner">{_SHORT}</div><main keep><h1>Main</h1><section><h2>First</h2><p>{_LONG}</p></section><section><h2>Second</h2><p>{_MORE}</p><table><tr><td>Cell</td><td>12</td></tr></table></section></main><div class="promo"><p>{_MORE}</p></div><div class="newsletter"><p>{_LONG}</p><form><input></form></div></body></html>',
    f'<html><body><header><p>{_SHORT}</p></header><article keep><h1>Tale</h1><p>{_SHORT}</p><p>{_SHORT}</p><div class="ad" drop><p>{_LONG}</p></div><p>{_LONG}</p></article><div id="comments"><p>{_READER}</p><p>{_READER}</p><ol><li><div><p>{_READER}</p></div></li></ol></div><aside><p>{_LONG}</p></aside><footer><nav>{_LINKS}</nav></footer></body></html>',
    f'<html><body><div class="notice"><p>{_LONG}</p></div><div role="main" keep><h1>Notes</h1><p>{_LONG}</p><pre>some code here</pre><p>{_MORE}</p></div><div role="complementary"><p>{_MORE}</p></div><div role="contentinfo"><p>{_SHORT}</p></div></body></html>',
    f'<html><body><nav><ul>{_LINKS}</ul></nav><article keep><h1>Only</h1><p>{_SHORT}</p></article><div class="advert"><p>{_MORE}</p></div><footer>{_LONG}</footer></body></html>',
    f'<html><body><p keep>{_LONG}</p><p keep>{_MORE}</p></body></html>',
    f'<html><body><h1 keep>Bare</h1><div keep>{_LONG}</div><div class="menu">{_LINKS}</div></body></html>',
]


def _named_page(n: dict[str, str], prose: tuple[str, str, str]) -> str:
    """A page of the usual parts, under the names that n gives them."""
    long_, line, talk = prose
    links = "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(line.split()[:4]))
    return (
        f'<html><body><div class="{n["top"]}"><a href="/">{line}</a></div><div class="{n["nav"]}"><ul>{links}</ul></div><div class="{n["notice"]}"><p>{line}</p></div>'
        f'<div class="{n["text"]}" keep><h1>{line}</h1><p>{long_}</p><div class="{n["ad"]}" drop><p>{line}</p></div><p>{long_}</p>'
        f'<div class="{n["share"]}" drop><a href="/s">{line}</a></div><p>{line}</p></div><div class="{n["side"]}"><p>{long_}</p><ul>{links}</ul></div>'
        f'<div class="{n["talk"]}"><p>{talk}</p><div><p>{talk}</p></div></div><div class="{n["more"]}"><h3>{line}</h3><ul>{links}</ul></div>'
        f'<form class="{n["form"]}"><p>{line}</p></form><div class="{n["foot"]}"><p>{long_}</p></div></body></html>'
    )


_PARTS = ("top", "nav", "notice", "text", "ad", "share", "side", "talk", "more", "form", "foot")
_PROSE = {
    "en": (_LONG, _LINE, _READER),
    "de": ("Ein langer Satz zur Sache, mit einigen Einzelheiten, einem Komma oder zweien und einem Punkt. Dann folgt ein zweiter, der weitergeht.", "Eine Zeile, die nicht sehr lang ist, aber Prosa.", "Das habe ich gern gelesen, auch wenn ich dem zweiten Teil gar nicht zustimme. Danke trotzdem."),
    "fr": ("Une longue phrase sur le sujet, avec quelques détails, une virgule ou deux et un point à la fin. Puis une seconde, qui continue.", "Une ligne qui n'est pas très longue, mais de la prose.", "J'ai lu cela avec intérêt, mais je ne suis pas d'accord avec la seconde partie. Merci quand même."),
    "es": ("Una frase larga sobre el asunto, con algún detalle, una coma o dos y un punto al final. Después viene otra, que sigue adelante.", "Una línea que no es muy larga, pero sí prosa.", "Lo he leído con interés, aunque no estoy de acuerdo con la segunda parte. Gracias de todos modos."),
    "pl": ("Długie zdanie o rzeczy, z paroma szczegółami, przecinkiem albo dwoma i kropką na końcu. Potem drugie, które idzie dalej.", "Linijka niezbyt długa, ale jednak proza.", "Przeczytałem z ciekawością, choć z drugą częścią się nie zgadzam. Mimo to dziękuję."),
}
#: Names of the parts, in their order, as sites give them.
_NAMED = [
    ("en", "site-header masthead", "main-navigation", "cookie-consent", "article-body", "ad-slot", "share-buttons", "sidebar widget-area", "comments-area", "related-posts", "newsletter-signup", "site-footer"),
    ("en", "topbar", "navbar", "gdpr-notice", "entry-content", "advertisement", "social-share", "rail", "comment-list", "read-more", "subscribe-form", "footer-inner"),
    ("en", "page-header", "menu", "alert-banner", "post-body", "sponsored-box", "sharing", "secondary", "discussion", "recommended", "search-form", "colophon"),
    ("en", "branding", "breadcrumbs", "notification", "story-text", "promo", "share-bar", "complementary", "responses", "trending", "login-form", "copyright"),
    ("en", "header", "nav", "cookies", "text", "ads", "social", "widget", "replies", "suggestions", "feedback-form", "legal"),
    ("de", "kopfzeile", "hauptnavigation", "cookie-hinweis", "artikel-text", "werbung", "teilen", "seitenleiste", "kommentare", "verwandte-artikel", "anmeldung", "fusszeile"),
    ("de", "seitenkopf", "menue", "hinweis", "beitrag-inhalt", "anzeige", "empfehlen", "randspalte", "leserbriefe", "mehr-zum-thema", "suche", "impressum"),
    ("fr", "entete", "navigation", "avis", "contenu", "publicite", "partager", "barre-laterale", "commentaires", "articles-lies", "formulaire", "pied-de-page"),
    ("es", "cabecera", "navegacion", "aviso", "contenido", "publicidad", "compartir", "barra-lateral", "comentarios", "relacionados", "formulario", "pie-de-pagina"),
    ("pl", "naglowek", "nawigacja", "powiadomienie", "tresc", "reklama", "udostepnij", "panel-boczny", "komentarze", "powiazane", "formularz", "stopka"),
]
PAGES += [_named_page(dict(zip(_PARTS, names)), _PROSE[lang]) for lang, *names in _NAMED]


def _beside_article(n: dict[str, str], prose: tuple[str, str, str]) -> str:
    """An article, and the other parts as blocks of prose around it."""
    long_, line, talk = prose
    block = lambda part: f'<div class="{n[part]}"><p>{long_}</p></div>'
    return (
        f'<html><body>{block("notice")}{block("nav")}<article keep><h1>{line}</h1><p>{long_}</p><p>{line}</p></article>{block("share")}{block("ad")}{block("side")}'
        f'<div class="{n["talk"]}"><p>{talk}</p><p>{long_}</p></div>{block("more")}{block("form")}{block("foot")}</body></html>'
    )


def _plain_text(n: dict[str, str], prose: tuple[str, str, str]) -> str:
    """The main part by its name alone, its prose in parts of it."""
    long_, line, _ = prose
    return (
        f'<html><body><div class="{n["text"]}" keep><h1>{line}</h1><div><p>{line}</p><p>{long_}</p></div><p>{line}</p></div>'
        f'<div class="{n["talk"]}"><div><p>{long_}</p></div><div><p>{line}</p></div></div><div class="{n["foot"]}">{line}</div></body></html>'
    )


PAGES += [make(dict(zip(_PARTS, names)), _PROSE[lang]) for make in (_beside_article, _plain_text) for lang, *names in _NAMED]

#: Names that say what the main part has or is beside, not what it is.
_BESIDE = [
    "content with-sidebar", "post no-sidebar", "entry-content share-enabled", "article-body has-comments", "post tag-news", "main has-ads", "content no-comments",
    "story with-related", "entry comments-open", "text has-share-buttons", "post category-reviews", "article with-footer", "content ad-free", "body with-menu",
    "prose no-ads", "entry tag-social", "main comments-closed", "article sharing-enabled", "content tag-cookies", "post has-footer",
]
PAGES += [
    f'<html><body><nav><ul>{_LINKS}</ul></nav><div class="{names}" keep><h1>Title</h1><p>{_LONG}</p><p>{_LINE}</p></div><div class="sidebar"><p>{_LINE}</p></div>'
    f'<div class="comments"><p>{_READER}</p></div><div class="share"><p>{_SHORT}</p></div><div class="ads"><p>{_LINE}</p></div><div class="footer"><p>{_SHORT}</p></div></body></html>'
    for names in _BESIDE
]
PAGES += [
    f'<html><body><nav>{_LINKS}</nav><article class="{names}" keep><h2>Title</h2><p>{_LINE}</p><p>{_MORE}</p></article><footer>{_SHORT}</footer></body></html>'
    for names in ("search-result-article", "post-card featured", "sidebar-article", "hentry tag-menu", "comment-free", "related-article")
]
PAGES += [
    f'<html><body><article keep><h1>T</h1><p>Said <span class="name">one</span> of <em class="quote">them</em>, and on. {_SHORT}</p><p class="meta" drop><span class="date">May 1</span> <a class="author" href="/a">One</a></p><p>{_LONG}</p></article></body></html>',
    f'<html><body><div class="header"><span>Site</span></div><div class="post" keep><header><h1>T</h1></header><p>{_LONG} <span class="highlight">Of note</span>, too.</p><footer drop><p>{_SHORT}</p></footer></div></body></html>',
]
