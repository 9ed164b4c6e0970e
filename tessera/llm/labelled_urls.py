"""A small labelled URL table, to fit the URL filter where no other is given.

Hosts of each kind stand under several domains and with several paths, so that
neither a domain nor a path says anything about the kind. None of the hosts
stands in the driver's tables.
"""

from __future__ import annotations

#: Names of sites to block: gambling, adult content, doubtful medicine, advertising and link spam.
BLOCKED = (
    "online-casino", "casino-royal", "lucky-casino", "mega-slots", "poker-bonus", "jackpot-slots", "big-win", "win-money", "sports-bets", "bets-now",
    "betting-tips", "roulette-bonus", "adult-video", "adult-cams", "xxx-tube", "sex-chat", "hot-adult", "porn-videos", "nude-x", "x-rated",
    "viagra-pills", "diet-pills", "pills-shop", "cheap-meds", "cheap-viagra", "weight-loss-pills", "no-prescription", "cheap-watches", "replica-bags", "free-money",
    "free-gifts", "free-iphone", "spam-links", "link-spam", "link-farm", "click-farm", "seo-farm", "click-ads", "ads-server", "popup-ads",
    "ad-track", "user-tracker", "track-clicks", "payday-loan", "quick-loans", "crypto-doubler",
)
#: Names of ordinary sites.
ALLOWED = (
    "news", "daily-herald", "library", "university", "weather", "museum", "recipes", "gardening", "travel-guide", "city-council",
    "open-data", "history", "science", "mathematics", "physics-notes", "philosophy", "open-source", "linux-kernel", "python-docs", "database",
    "photography", "architecture", "railway-times", "hiking-trails", "cycling", "football-club", "chess", "theatre", "orchestra", "radio",
    "newspaper", "publisher", "bookshop", "dictionary", "encyclopedia", "archive", "school", "teachers", "hospital", "health-service",
    "parliament", "ministry", "insurance", "bank", "post-office", "housing", "energy", "climate", "forestry", "fisheries",
    "thornton", "therese", "nathan", "winchester", "farmhouse", "trackside", "addison", "freedom", "pillar", "tionne",
    "haushalt", "zeitung", "buecher", "schule", "journal", "bibliotheque", "jardin", "cuisine", "noticias", "biblioteca",
    "escuela", "cocina", "thierry", "anderson", "rothen", "heather", "erlangen", "steinmetz", "oregon", "montrer",
    "wetter", "verein", "musique", "viajes", "enseigner", "hertha", "inlander", "ontario", "reading", "thousand",
)
_FRONTS, _DOMAINS, _PATHS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "invalid"), ("/", "/en/17", "/de/204.html", "/fr/31/", "/es/880", "/index.html", "/en/593.html", "/de/6/")


def table() -> list[tuple[str, int]]:
    """(url, block 0/1) of every site under two domains."""
    rows = []
    for block, names in ((1, BLOCKED), (0, ALLOWED)):
        for k, name in enumerate(names):
            for j in (k, 3 * k + 1):
                rows.append((f"https://{_FRONTS[(j // 2) % 4]}{name}.{_DOMAINS[j % 4]}{_PATHS[j % 8]}", block))
    return rows
