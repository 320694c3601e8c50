"""Enumerations, thresholds, word lists and patterns that results depend on.

Everything here is data; the rules that use it live in the operator modules.
"""

from __future__ import annotations

# --- page and article kinds -------------------------------------------------------------------------------------
ALLOWED_PTYPES = ("artikel", "paywall", "timeline", "blog")
TIMELINE_PTYPES = ("timeline", "blog")
PAGE_KINDS = ("article", "section", "media", "interactive", "sponsored", "service", "error", "unknown", "alias", "archive")
REF_PRIORITY = {"home": 0, "section": 1, "feed": 2, "sitemap": 3}
MAX_REFS = 6

# --- link state ---------------------------------------------------------------------------------------------------
# Hours without a link sighting after which an article of the source counts as gone; other sources take the default.
ONLINE_TOLERANCE_H = {1: 72, 3: 26, 4: 26, 5: 6, 6: 36}
ONLINE_TOLERANCE_DEFAULT_H = 26
RESIGHT_HOURS = 2

# --- limits -------------------------------------------------------------------------------------------------------
ARTICLE_MAX_AGE_DAYS = 30
CORPUS_DAYS = 35
SIGHTING_DAYS = 35
SNAPSHOT_PAYLOAD_DAYS = 14
EXTENSION_KEEP = 60
SCAN_TIMES_KEEP = 150
HISTORY_KEEP = 8
PARA_MIN_CHARS = 60
PARA_KEEP = 400
PARA_CHARS = 8000
BODY_MIN_CHARS = 1200
PUBDATE_TOLERANCE_S = 60

# --- topics: ordered, first match wins ------------------------------------------------------------------------------
TOPIC_PATTERNS = (
    ("regional", r"(\brhein-main\b|\bregionale?s?\b|\bregionalnachrichten\b|\blokales?\b|\baus-den-regionen\b)"),
    ("meinung", r"(meinung|kommentar|kolumne|standpunkt|gastbeitrag|debatte|leitartikel|opinion|id´?e?es|tribune|chronique|editorial|le-club|blogs?)"),
    ("sport", r"(sport|fussball|fußball|bundesliga|champions|tennis|olympia|formel ?1|football|rugby|cyclisme|basket|nba|wm-|em-|roland-garros|hooligan)"),
    ("wirtschaft", r"(wirtschaft|finanz|boerse|börse|aktie|economie|économie|geld|unternehmen|konjunktur|handel|arbeitsmarkt|immobilien|steuer|verbraucher|emploi|argent|job|karriere|shopping-und-service)"),
    ("digital", r"(digital|netzwelt|netzpolitik|techn|pixels|\bki\b|k%C3%BCnstliche-intelligenz|kuenstliche-intelligenz|internet|computer|smartphone|games?|gaming|cyber)"),
    ("wissen", r"(wissen|wissenschaft|forschung|science|sciences|klima|umwelt|natur|energie|weltraum|raumfahrt|planete|planète|biolog|physik|gesund.{0,3}umwelt|geschichte|histoire|campus|bildung|education|schule|universit)"),
    ("gesundheit", r"(gesundheit|medizin|sant[eé]|pflege|krankheit|psycholog|ern[aä]hrung|ratgeber.*gesund|tofu|dialyse|fitness|diaet|diät)"),
    ("kultur", r"(kultur|culture|feuilleton|fotografie|unterhaltung|kino|cinema|cinéma|film|musik|musiques?|literatur|livres?|buch|b[uü]cher|kunst|\barts?\b|theater|medien|fernsehen|\btv\b|serie|streaming|festival|effilee|gastronom|le-gout|bande-dessinee)"),
    ("reise", r"(reise|travel|tourism|voyage|urlaub)"),
    ("auto", r"(auto|mobilit|motor|verkehr|bahn|luftfahrt|e-auto)"),
    ("panorama", r"(panorama|gesellschaft|vermischt|leute|menschen|boulevard|stars|royal|soci[eé]t[eé]|faits-divers|justiz|kriminal|aus-aller-welt|der[-_]tag|tagesthemen|produkt-check|ratgeber|besser-leben|m-perso|m-le-mag|\bvous\b|l-epoque|epoque|le-gout-du-monde|specials|disparitions|religions?|tagesschau|\bstil\b|familie|famille|lifestyle|deinspiegel|dein-spiegel|ticker|infografik)"),
    ("politik", r"(politik|inland|ausland|international|europa|amerika|asien|afrika|ozeanien|nahost|naher-osten|ukraine|wahl|bundestag|einspruch|politique|étranger|etranger|\bmonde\b|gouvernement|election|les-decodeurs|decodeurs|faktenfinder|faktencheck|investigativ|immigration|midterms|presidentielle|correspondents?)"),
)
TOPIC_FALLBACK = "sonstiges"

# --- edit classification ----------------------------------------------------------------------------------------------
TAG_PRIORITY = ("factual", "anonymization", "attribution", "typo", "sharpened", "toned", "deletion", "addition", "showcase", "rephrase")
HEDGE_WORDS = (
    "soll", "sollen", "solle", "sollte", "angeblich", "mutmaßlich", "mutmasslich", "vermeintlich", "offenbar",
    "möglicherweise", "moeglicherweise", "wohl", "vermutlich", "sogenannte", "sogenannten", "sogenannter", "laut",
    "zufolge", "berichten", "demnach", "womöglich", "womoeglich", "angeben", "sei", "seien", "habe", "hätten", "haetten",
)
HEDGE_PHRASE = r"\bnach angaben\b|\bBerichten zufolge\b|\bnach informationen\b"
HEAT_WORDS = (
    "skandal", "eklat", "empörung", "empoerung", "wut", "chaos", "debakel", "drama", "dramatisch", "schock",
    "schockierend", "brutal", "brisant", "explosiv", "alarm", "krise", "verheerend", "katastrophal", "katastrophe",
    "wirbel", "aufregung", "zoff", "knall", "attacke", "eskalation", "massiv", "heftig", "wütend", "wuetend",
    "entsetzt", "empört", "empoert", "hammer", "beben", "desaster", "fiasko", "schande", "wahnsinn", "horror", "panik",
)
ROLE_WORDS = (
    "angeklagte", "angeklagten", "beschuldigte", "beschuldigten", "tatverdächtige", "tatverdaechtige", "verdächtige",
    "verdaechtige", "betroffene", "betroffenen", "opfer", "täter", "taeter", "mann", "frau", "jugendliche",
    "jugendlichen", "person", "familie", "mitarbeiter", "kläger", "klaeger", "patient", "patientin",
)
HEADLINE_COOLING = r"(skandal|empörung|rücktritt|massiv|schock|attacke|covering up|accused)"
HEADLINE_HEATING = r"(attacke|massiv|skandal|despido|recorta|großeinsatz)"

# --- paragraphs -------------------------------------------------------------------------------------------------------
BOILERPLATE = (
    r"cet article vous est offert|réservé aux abonnés|article réservé|pour lire (gratuitement|cet)|connectez-vous"
    r"|inscrivez-vous|vous n.?êtes pas inscrit|déjà abonné|s.?abonner|abonnez-vous|se connecter|newsletter"
    r"|cookies? (akzeptieren|zustimmen|verwalten)|alle akzeptieren|datenschutz|jetzt anmelden|mit bild plus|spiegel\+ lesen"
)
# each form of boilerplate has one of these in its lower case
BOILERPLATE_PARTS = (
    "est offert", "réservé", "pour lire", "connect", "inscri", "abonn", "newsletter", "cookie", "alle akzeptieren", "datenschutz", "jetzt anmelden",
    "bild plus", "spiegel+",
)

# --- rubrics ----------------------------------------------------------------------------------------------------------
RUBRIC_SKIP = (
    "aktuell", "article", "articles", "news", "nachrichten", "story", "html", "amp",
    "de", "en", "fr", "thema", "themen", "a", "id",
)
# (key, label, name parts) - compound names come before the simple ones they contain
FEDERAL_STATES = (
    ("baden-wuerttemberg", "Baden-Württemberg", ("baden wuerttemberg", "baden wurttemberg")),
    ("bayern", "Bayern", ("bayern",)),
    ("berlin-brandenburg", "Berlin & Brandenburg", ("berlin und brandenburg",)),
    ("mecklenburg-vorpommern", "Mecklenburg-Vorpommern", ("mecklenburg vorpommern", "mecklenburgvorpommern")),
    ("nordrhein-westfalen", "Nordrhein-Westfalen", ("nordrhein westfalen", "nordrheinwestfalen")),
    ("rheinland-pfalz", "Rheinland-Pfalz", ("rheinland pfalz", "rheinlandpfalz")),
    ("sachsen-anhalt", "Sachsen-Anhalt", ("sachsen anhalt", "sachsenanhalt")),
    ("schleswig-holstein", "Schleswig-Holstein", ("schleswig holstein", "schleswigholstein")),
    ("brandenburg", "Brandenburg", ("brandenburg",)),
    ("niedersachsen", "Niedersachsen", ("niedersachsen",)),
    ("thueringen", "Thüringen", ("thueringen", "thuringen")),
    ("bremen", "Bremen", ("bremen",)),
    ("hamburg", "Hamburg", ("hamburg",)),
    ("hessen", "Hessen", ("hessen",)),
    ("saarland", "Saarland", ("saarland",)),
    ("sachsen", "Sachsen", ("sachsen",)),
    ("berlin", "Berlin", ("berlin",)),
)
CANON_CATEGORIES = (
    ("politik", "Politik", ("politik", "politique", "political", "politisch")),
    ("international", "International", ("ausland", "international", "étranger", "monde", "europa", "europe", "foreign", "world", "außenpolitik")),
    ("national", "National / Inland", ("inland", "national", "france", "deutschland", "germany", "allemagne", "innenpolitik")),
    ("wirtschaft", "Wirtschaft", ("wirtschaft", "économie", "economy", "business", "finanzen", "finances", "geld", "markt")),
    ("sport", "Sport", ("sport", "sports", "fussball", "football", "soccer", "bundesliga", "ligue")),
    ("kultur", "Kultur", ("kultur", "culture", "kulturell", "art", "arts", "kino", "film", "musik", "musique", "litterature")),
    ("gesellschaft", "Gesellschaft", ("gesellschaft", "société", "social", "soziales", "leben", "vie", "famille")),
    ("wissenschaft", "Wissenschaft & Tech", ("wissenschaft", "sciences", "technologie", "technology", "tech", "forschung", "innovation", "numerique", "digital")),
    ("gesundheit", "Gesundheit", ("gesundheit", "santé", "health", "medizin", "médecine", "medical")),
    ("umwelt", "Umwelt & Klima", ("umwelt", "klima", "environnement", "environment", "climate", "natur", "nature", "ecologie", "energie")),
    ("meinung", "Meinung", ("meinung", "opinion", "kommentar", "commentary", "analyse", "analysis", "debat", "debatte")),
    ("regional", "Regional", ("regional", "local", "lokal", "region", "bundesland", "departement")),
    ("reise", "Reise", ("reise", "voyage", "tourisme", "tourism", "travel", "urlaub", "ferien")),
    ("medien", "Medien", ("medien", "médias", "media", "presse", "press", "fernsehen", "television")),
)
