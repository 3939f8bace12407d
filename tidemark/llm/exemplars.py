"""The labelled exemplars of template residue, filler, error pages and script notices that are used if none are given."""

from __future__ import annotations

from itertools import product

# ---- fixed values: the reason phrases of HTTP statuses -------------------------------------------------------
STATUSES = [
    "Bad Request", "Unauthorized", "Payment Required", "Forbidden", "Not Found", "Method Not Allowed", "Not Acceptable",
    "Request Timeout", "Conflict", "Gone", "Too Many Requests", "Internal Server Error", "Not Implemented",
    "Bad Gateway", "Service Unavailable", "Gateway Timeout", "Service Temporarily Unavailable",
]
# ---- end of fixed values ------------------------------------------------------------------------------------
#: Words of one meaning, by the name of the meaning: an exemplar in one wording then holds for the others.
CONCEPTS = {
    word: meaning
    for meaning, words in {
        "SCRIPT": "javascript js script scripts scripting ecmascript",
        "ENABLE": "enable enabled enabling activate activated allow allowed permit",
        "DISABLED": "disabled deactivated blocked",
        "NEED": "need needs require requires required relies",
        "FOUND": "found located find",
        "GONE": "gone removed deleted moved missing",
        "OVERLOADED": "overloaded overload unavailable unreachable busy",
    }.items()
    for word in words.split()
}
#: In an exemplar "*" stands for anything that differs from case to case.
STATUS_PAGES = [
    "404 {0}", "Error 404 {0}", "HTTP Status 404 {0}", "HTTP error 404 {0}", "404 {0} {0} nginx", "404 {0} {0} gate *",
    "error code 404 message {0}", "status 404 detail {0} trace *", "status 404 error {0} path *",
    "Error Code {0} Code RequestId *", "xml version encoding Error Code {0} RequestId *",
    "That's an error 404. {0}. That's all we know.", "{0} (404)",
]
ERROR_PAGES = [
    "We can't find the page you're looking for.", "It may have moved.", "The page you requested could not be found.",
    "The report you asked for could not be located.", "The requested URL was not found on this server.",
    "The engine closed the connection early.", "The server closed the connection before answering.",
    "Try again in * minutes.", "Please try again later.", "If this goes on, tell the desk and quote *.",
    "If the problem persists, contact support and quote *.", "Reference *", "Reference id *", "Access denied.",
    "You do not have permission to view this page.", "You do not have permission to open this notebook.",
    "Log in to go on.", "Log in to continue.", "Your session has expired.", "You were signed out after * minutes.",
    "Sign in again to view *.", "Oops! Something went wrong.", "Oops! Something went wrong on our side.", "Oops!", "Whoops, that link is broken.",
    "Could not load data for *: empty response", "KeyError: '*'", "upstream request failed: reset before headers, id *",
    "Connection timed out after * ms while fetching the page", "The dashboard is down for maintenance until *",
    "We are down for scheduled maintenance and will be back shortly.", "Rate limit hit, slow down (* calls).",
    'ERROR: relation "*" does not exist', "java.lang.IllegalStateException: book * is closed",
    "at desk.Book.get(Book.java:*)", "Traceback (most recent call last):", "File * line * in *",
    "This site can't be reached.", "You have been blocked.", "An unexpected error occurred while processing your request.",
    "La page demandée est introuvable.", "Seite nicht gefunden.", "La página solicitada no existe.",
    "Su cuenta no tiene acceso a este informe.", "Không tìm thấy trang bạn yêu cầu.", "该页面不存在或已被删除。",
    "Une erreur est survenue sur le serveur.", "Es ist ein Fehler aufgetreten.",
    "Sorry, this page is missing.", "Sorry, this document has been removed.", "This page no longer exists.", "Sorry, we couldn't find that page.",
    "The page you were looking for does not exist.", "Nothing was found at this address.", "No page was found here.", "This link is broken or has expired.",
    "Nothing was found at this address (HTTP 404).", "Server overloaded.", "The server is overloaded, try again later.", "The service is temporarily unavailable.",
    "The server encountered an internal error.", "An error occurred while processing your request.", "Please come back later.",
    "You are not authorized to view this page.", "You need permission to access this page.", "Please sign in to continue.",
]
SCRIPT_NOTICES = [
    "This page needs JavaScript to run.", "This site requires JavaScript.", "This page requires scripts to be switched on.",
    "This page relies on client-side scripting.", "This page does not work without JavaScript.",
    "This page cannot be shown while scripts are blocked.", "This page is a script-only application.",
    "This dashboard needs JavaScript to run.", "The notebook does not work without JavaScript.",
    "Our chart page relies on client-side scripting.", "The equity panel is a script-only application.",
    "The report viewer requires scripts to be switched on.", "This dashboard cannot be shown while scripts are blocked.",
    "Then refresh.", "Then reload the page.", "Enable it in your browser settings.", "Please turn it on and reload.", "See the help page for * supported browsers.",
    "Allow scripts and cookies to continue.", "JavaScript is disabled.", "JavaScript is disabled in your browser.",
    "Your browser blocks cookies and scripts; allow both to continue.", "Please enable JavaScript to continue.",
    "Please enable JavaScript and cookies to view this page.", "You need to enable JavaScript to run this app.",
    "Turn off your script blocker to view *.", "Turn off your ad blocker to view this page.",
    "Checking your browser before opening the report, this page refreshes by itself.",
    "Checking your browser before accessing this site.", "Loading, if this takes long, check that scripts are allowed.",
    "Some panels will not load.", "Scripts are switched off, so nothing can be shown here.",
    "You need to enable scripts in your browser to see the equity curve.", "Active JavaScript para ver este panel.",
    "Veuillez activer JavaScript pour afficher ce tableau.", "Vui lòng bật JavaScript để xem bảng.",
    "This web app needs a browser with JavaScript.", "JavaScript must be enabled.", "JavaScript is not enabled.", "Turn on JavaScript.",
    "Switch it on, then come back.", "Turn it on and reload.", "Your browser does not support JavaScript.", "This content is only shown with JavaScript enabled.",
    "请启用 JavaScript 后继续浏览。", "Bitte aktivieren Sie JavaScript, um die Auswertung zu sehen.",
]
FILLER_KINDS = ["Draft", "Dummy", "Example", "Mock", "Placeholder", "Sample"]
FILLER_PARTS = ["body", "caption", "copy", "paragraph", "section", "summary", "text"]
FILLER_NOTES = [
    "number *", "to be replaced", "will follow", "goes here", "used to check the layout", "for the second column",
    "swap before release",
]
FILLER = [
    "Heading one. Heading two. Your summary starts here.", "Heading one. Heading two.", "Your summary starts here.",
    "Your text here.", "Insert text here.", "Write a catchy intro of about two sentences.",
    "This is dummy text for layout purposes only.", "The quick brown fox jumps over the lazy dog.",
    "此处填写正文。", "Aquí va el texto de ejemplo.", "Nội dung mẫu.", "Hier steht später der Bericht.", "Ici votre texte.",
]
#: General passages of made-up and classical Latin: texts as templates are filled with, and what such words look like.
LATIN_PASSAGES = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, "
    "eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos "
    "qui ratione voluptatem sequi nesciunt.",
    "Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam "
    "eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.",
    "Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea "
    "commodi consequatur?",
    "Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui "
    "dolorem eum fugiat quo voluptas nulla pariatur?",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque "
    "corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa "
    "qui officia deserunt mollitia animi, id est laborum et dolorum fuga.",
    "Et harum quidem rerum facilis est et expedita distinctio.",
    "Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere "
    "possimus, omnis voluptas assumenda est, omnis dolor repellendus.",
    "Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates "
    "repudiandae sint et molestiae non recusandae.",
    "Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut "
    "perferendis doloribus asperiores repellat.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
    "Class aptent taciti sociosqu ad litora torquent per conubia nostra, per inceptos himenaeos.",
    "Cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus.",
    "Stet clita kasd gubergren, no sea takimata sanctus est lorem ipsum dolor sit amet.",
    "Vestibulum id ligula porta felis euismod semper. Nullam quis risus eget urna mollis ornare vel eu leo. Etiam porta sem malesuada magna "
    "mollis euismod. Maecenas sed diam eget risus varius blandit sit amet non magna. Aenean lacinia bibendum nulla sed consectetur. Donec "
    "ullamcorper nulla non metus auctor fringilla. Praesent commodo cursus magna, vel scelerisque nisl consectetur et. Integer posuere erat a "
    "ante venenatis dapibus posuere velit aliquet. Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa "
    "justo sit amet risus. Curabitur blandit tempus porttitor. Duis mollis, est non commodo luctus, nisi erat porttitor ligula, eget lacinia odio "
    "sem nec elit. Nulla vitae elit libero, a pharetra augue.",
    "In principio creavit Deus caelum et terram. Terra autem erat inanis et vacua, et tenebrae erant super faciem abyssi, et spiritus Dei "
    "ferebatur super aquas. Dixitque Deus: fiat lux, et facta est lux. Et vidit Deus lucem quod esset bona, et divisit lucem a tenebris.",
    "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli "
    "appellantur. Hi omnes lingua, institutis, legibus inter se differunt. Horum omnium fortissimi sunt Belgae, propterea quod a cultu atque "
    "humanitate provinciae longissime absunt, minimeque ad eos mercatores saepe commeant atque ea quae ad effeminandos animos pertinent important.",
    "Arma virumque cano, Troiae qui primus ab oris Italiam fato profugus Laviniaque venit litora, multum ille et terris iactatus et alto vi "
    "superum, saevae memorem Iunonis ob iram, multa quoque et bello passus, dum conderet urbem inferretque deos Latio.",
    "Quousque tandem abutere, Catilina, patientia nostra? Quam diu etiam furor iste tuus nos eludet? Quem ad finem sese effrenata iactabit audacia?",
    "O fortuna, velut luna statu variabilis, semper crescis aut decrescis; vita detestabilis nunc obdurat et tunc curat ludo mentis aciem; "
    "sors immanis et inanis, rota tu volubilis, status malus, vana salus semper dissolubilis.",
    "Pater noster, qui es in caelis, sanctificetur nomen tuum, adveniat regnum tuum, fiat voluntas tua, sicut in caelo et in terra. "
    "Panem nostrum quotidianum da nobis hodie, et dimitte nobis debita nostra.",
    "Fama volat. Verba volant, scripta manent. Tempus fugit. Pecunia non olet. Tabula rasa. Gutta cavat lapidem. Errare humanum est. "
    "Vox populi, vox dei. Ordo ab chao. Sapere aude. Nulla dies sine linea. Amicus certus in re incerta cernitur. Quies post laborem. "
    "Aequam memento rebus in arduis servare mentem. Carpe diem, quam minimum credula postero. Fundus mendax. Gradus ad Parnassum.",
]
#: Filler as it is typed.
MASHED = "asdf asdf asdfgh qwer qwerty zxcv foo bar baz qux blah blah test test testing xxx abc abc xyz numbers"
#: What stands around a page's content on every page: neither content nor residue.
CHROME = [
    "Menu Reports Settings Sign out", "Home Folds Pairs Live Help", "Skip to content", "© research desk",
    "« back to overview", "Zurück zur Übersicht.", "Home About Contact Privacy", "All rights reserved.",
]
#: Names a template's slots go by; in brackets that prose also uses, only these count.
SLOTS = (
    "amount|author|beta|company|cost|cost_bps|cost in bps|date|desk|entry_z|exit_ts|first name|fold|fold number|half_life|"
    "last name|leg_a|leg_b|month|n_trades|name|pair|pair_id|realized_pnl|report.date|reviewer|run_id|ticker|title|"
    "value|year|your name"
)
#: Unfilled placeholders in running text, as exemplars of shape: (literals, pattern). A shape is retrieved by its literal:
#: one of them, in lower case, stands in every text of that shape.
PLACEHOLDERS = [
    (["{{"], r"\{\{\{?[#/^>&!]?\s*[\w. ]+\}?\}\}"),
    (["{%"], r"\{%-?\s*[a-z]\w*[^%{}\n]*%\}"),
    (["<%"], r"<%[=-]?\s*[\w. ]+%>"),
    (["{"], r"[$#]\{\s*[\w.]+\s*\}"),
    (["{$"], r"\{\$[A-Za-z_][\w.]*\}"),
    (["$"], r"\$(?:" + SLOTS + r")\$"),
    (["<<"], r"<<\s*[A-Za-z_][\w. ]*>>"),
    (["&lt;"], r"&lt;(?:" + SLOTS + r")&gt;"),
    ([":"], r"(?<!\S):(?:" + SLOTS + r"):(?!\S)"),
    (["%"], r"(?<!\S)%[sd](?!\S)"),
    (["xx.xx"], r"(?<!\S)XX\.XX(?!\S)"),
    (["undefined"], r"(?<!is )(?<!are )(?<!was )(?<!were )(?<!be )(?<!left )(?<!an )(?<!\S)undefined(?!\S)"),
    (["yyyy-mm-dd"], r"(?<!format )(?<!as )(?<!form )(?<!written )(?<!like )(?<!\S)YYYY-MM-DD(?!\S)"),
    (["{"], r"(?<![\w\\{$#%])\{\s*(?:\d{1,2}|[A-Za-z_][\w.]*)?\s*\}(?![\w}])"),
    (["%("], r"%\([A-Za-z_][\w.]*\)[sdf]"),
    (["%"], r"\[?(?<![\w%])%[A-Za-z_][\w.]+%(?![\w%])\]?"),
    (["@@"], r"@@\w+@@"),
    (["__"], r"(?<!\w)__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?!\w)"),
    (["____"], r"(?<![\w])_{4,}(?![\w])"),
    (["???"], r"\?{3}[\w. ]+\?{3}"),
    (["["], r"\[\s*(?:insert|enter|fill in|add|your|type)\s[^\[\]\n]+\]"),
    (["["], r"\[[^\[\]\n]+\s[-–—]\s?(?:fill in|to fill|tbd|tbc)\]"),
    (["["], r"\[(?:" + SLOTS + r")\s?\?\]"),
    (["[["], r"\[\[\s*(?:" + SLOTS + r")\s*\]\]"),
    (["["], r"\[(?:" + SLOTS + r")\](?!\()"),
    (["["], r"(?-i:\[[A-Z]{2,}(?: [A-Z]+)+\])(?!\()"),
    (["<"], r"<(?:insert|enter|your|add)\s[^<>\n]+>"),
    (["<"], r"<[^<>\n/]+\s(?:goes here|here)>"),
    (["<"], r"<(?:" + SLOTS + r")>(?![^\n]*</)"),
    (["todo", "tbd", "tbc", "fixme"], r"(?<!\w)(?:TODO|TBD|TBC|FIXME)\s?[:(]\s?(?:" + SLOTS + r")(?!\w)"),
    (["["], r"\[(?:DATUM EINFÜGEN|FECHA AQUÍ|à compléter|điền ngày|NOMBRE AQUÍ|hier einfügen|请填写)\]"),
    (["[object"], r"\[object Object\]"),
    (["#"], r"#(?:REF|NAME|VALUE|DIV/0)[!?]"),
    (["#"], r"[$€£]#[.,]?#+"),
]


def labelled() -> list[tuple[str, str]]:
    """(label, exemplar) of all exemplars in words; pages of HTTP statuses and dummy sentences are built from rules."""
    pages = [page.format(status) for page, status in product(STATUS_PAGES, STATUSES)]
    dummies = [" ".join(x) for x in product(FILLER_KINDS, FILLER_PARTS, FILLER_NOTES)]
    parts = {
        "error": pages + ERROR_PAGES, "scripts": SCRIPT_NOTICES, "filler": dummies + FILLER, "latin": LATIN_PASSAGES, "mashed": [MASHED], "chrome": CHROME,
    }
    return [(label, e) for label, all_of in parts.items() for e in all_of]
