"""Word lists and patterns of the enrichment rules, as data."""

from __future__ import annotations

# Words that a query may hold without asking for anything.
FILLER = (
    "a", "an", "the", "of", "on", "in", "at", "with", "and", "or", "my", "me", "i", "to", "for", "from",
    "show", "find", "search", "all", "some", "any", "that", "this", "which", "where", "when", "is", "are",
    "was", "were", "photo", "photos", "pic", "pics", "picture", "pictures", "image", "images",
)

# What devices call the picture of a screen, in names of folders and at the beginning of those of files. Nothing else spells them.
CAPTURE_FOLDER = "Screenshot"
CAPTURE_FILES = ("screenshot", "screen_shot", "scr", "capture")

# Words that a category query may hold besides the category's names.
CATEGORY_FILLER = ("my", "the", "a", "an", "all", "of", "and", "in", "from", "screenshot", "screenshots")

# Ligatures and digraphs with their plain letters.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn",
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
}

# Named HTML entities.
HTML_NAMES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "deg": "°", "times": "×",
    "divide": "÷", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "laquo": "«", "raquo": "»", "sect": "§", "para": "¶", "plusmn": "±",
}

# Categories in their order, with their labels.
CATEGORY_LABELS = {
    "shopping": "Shopping", "movies": "Movies & TV", "food": "Food", "payments": "Payments & bills", "chats": "Chats", "travel": "Travel & tickets",
    "events": "Events", "social": "Social posts", "music": "Music", "maps": "Places & maps", "code": "Code & tech", "documents": "Documents & notes",
    "news": "News & articles", "memes": "Memes",
}

# Words of a text that speak for a category.
CATEGORY_KEYWORDS = {
    "shopping": ("add to cart", "buy now", "add to bag", "wishlist", "free delivery", "mrp", "% off", "in stock", "size chart", "inclusive of all taxes", "cash on delivery", "ratings", "offers"),
    "movies": ("movie", "film", "trailer", "imdb", "director", "netflix", "prime video", "hotstar", "jiocinema", "zee5", "sonyliv", "season", "episode", "web series", "box office", "in cinemas", "in theatres", "bookmyshow", "ott", "rotten tomatoes", "watchlist", "starring", "release date"),
    "food": ("swiggy", "zomato", "menu", "recipe", "ingredients", "restaurant", "dine", "delivery fee", "biryani", "pizza", "add item"),
    "payments": ("paid", "payment successful", "transaction", "txn", "debited", "credited", "a/c", "invoice", "receipt", "gst", "upi ref", "utr", "ref no", "bank", "google pay", "phonepe", "paytm", "bhim", "amount", "balance"),
    "chats": ("typing…", "typing...", "online", "last seen", "forwarded", "message", "reply", "you deleted this message"),
    "travel": ("pnr", "boarding", "flight", "train", "irctc", "departure", "arrival", "gate", "seat", "hotel", "check-in", "check in", "booking id", "makemytrip", "goibibo", "indigo", "air india", "redbus", "uber", "ola", "rapido", "coach", "berth", "platform"),
    "events": ("invite", "invitation", "rsvp", "event", "venue", "save the date", "wedding", "birthday", "meeting", "webinar", "zoom", "google meet"),
    "social": ("likes", "followers", "following", "retweet", "repost", "comments", "reel", "views", "subscribe"),
    "music": ("now playing", "lyrics", "album", "playlist", "artist", "song", "spotify", "jiosaavn", "gaana"),
    "maps": ("directions", "route", "navigate", "location", "address", "pincode", "pin code", "near me"),
    "code": ("error", "exception", "function", "import ", "class ", "const ", "npm ", "git ", "stack trace", "null", "undefined"),
    "documents": ("pdf", "document", "aadhaar", "pan card", "certificate", "form", "page 1", "notes"),
    "news": ("breaking", "reported", "according to", "min read", "minutes read", "news"),
    "memes": ("meme", "😂", "🤣"),
}

# Apps that speak for a category.
CATEGORY_APPS = {
    "shopping": ("amazon", "flipkart", "myntra", "meesho", "ajio", "nykaa", "snapdeal", "blinkit", "zepto", "bigbasket", "tata cliq", "croma"),
    "movies": ("netflix", "prime video", "hotstar", "jiocinema", "zee5", "sonyliv", "mx player", "bookmyshow"),
    "food": ("swiggy", "zomato", "domino", "eatsure", "magicpin"),
    "payments": ("gpay", "google pay", "phonepe", "paytm", "bhim", "cred", "mobikwik"),
    "chats": ("whatsapp", "telegram", "messages", "signal", "messenger"),
    "travel": ("irctc", "makemytrip", "goibibo", "indigo", "uber", "ola", "rapido", "redbus", "cleartrip", "ixigo", "airbnb"),
    "events": ("calendar", "eventbrite", "meet", "zoom", "district"),
    "social": ("instagram", "twitter", "facebook", "threads", "snapchat", "linkedin", "reddit", "youtube", "x"),
    "music": ("spotify", "jiosaavn", "gaana", "wynk", "youtube music", "apple music"),
    "maps": ("maps", "google maps"),
    "code": ("github", "termux", "vs code"),
    "documents": ("drive", "docs", "adobe", "keep", "notes", "word"),
    "news": ("inshorts", "dailyhunt", "google news", "news"),
    "memes": (),
}

# Words of a query that name a category.
CATEGORY_SYNONYMS = {
    "shopping": ("shopping", "shop"),
    "movies": ("movie", "movies", "film", "films", "cinema", "tv", "series", "show", "shows"),
    "food": ("food", "recipe", "recipes", "cooking"),
    "payments": ("payment", "payments", "paid", "bill", "bills", "receipt", "receipts", "invoice", "transaction", "transactions", "upi"),
    "chats": ("chat", "chats", "message", "messages", "conversation", "conversations"),
    "travel": ("travel", "ticket", "tickets", "trip", "trips", "booking", "bookings"),
    "events": ("event", "events", "invite", "invites", "invitation", "invitations"),
    "social": ("post", "posts", "social"),
    "music": ("music", "song", "songs", "playlist", "playlists"),
    "maps": ("map", "maps", "place", "places", "location", "locations", "directions"),
    "code": ("code", "programming", "terminal"),
    "documents": ("document", "documents", "notes", "note", "doc", "docs"),
    "news": ("news", "article", "articles", "headline"),
    "memes": ("meme", "memes", "funny", "joke", "jokes"),
}

# Interface phrases of apps with their weights; "+" joins parts that must all appear.
APP_PHRASES = {
    "WhatsApp": {"end-to-end encrypted": 2, "tap here for contact info": 2, "this message was deleted": 2, "you deleted this message": 2, "type a message": 2, "chats+updates+communities+calls": 3, "missed voice call": 1, "missed video call": 1, "last seen": 1, "forwarded": 1, "typing…": 1, "typing...": 1, "view once": 1, "disappearing messages": 2},
    "Instagram": {"liked by": 1, "view all comments": 2, "add a comment": 1, "suggested for you": 1, "original audio": 1, "follow back": 1, "edit profile+share profile": 2, "posts+followers+following": 2, "add to story": 1, "your story": 1, "send message": 1},
    "YouTube": {"subscribe": 1, "subscribers": 1, "shorts": 1, "remix": 1, "home+shorts+subscriptions": 3, "up next": 1, "add a comment...": 1},
    "GitHub": {"pull requests": 1, "issues": 1, "fork": 1, "forks": 1, "contributors": 1, "readme.md": 1, "repositories": 1, "commits": 1, "code+issues+pull requests": 2},
    "LinkedIn": {"repost": 1, "reposts": 1, "• 1st": 2, "• 2nd": 2, "• 3rd": 2, "my network": 2, "connections": 1, "endorse": 1, "promoted": 1, "home+post+notifications+jobs": 3},
    "X": {"retweet": 2, "post your reply": 2, "for you+following": 1, "quote": 1, "reposts": 1},
    "Reddit": {"join the conversation": 2, "upvote": 2, " r/": 1, " u/": 1, "join": 1, "award": 1, "sort by": 1},
    "Facebook": {"what's on your mind": 2, "like+comment+share": 2, "marketplace": 1, "add friend": 1},
    "Snapchat": {"send a chat": 2, "spotlight": 1, "snap map": 2},
    "Telegram": {"last seen recently": 2, "members": 1, "subscribers": 1, "broadcast": 1},
    "Gmail": {"reply all": 1, "to me": 1, "inbox": 1, "promotions": 1, "compose": 1, "search in mail": 2},
    "Google": {"people also ask": 2, "about this result": 2, "ai overview": 2, "all images videos": 2, "sponsored": 1, "search labs": 1},
    "ChatGPT": {"message chatgpt": 2, "chatgpt can make mistakes": 2},
    "Gemini": {"ask gemini": 2, "gemini can make mistakes": 2},
    "Google Pay": {"google transaction id": 2, "upi transaction id": 1, "paid to": 1},
    "PhonePe": {"phonepe transaction id": 2, "transaction successful": 1, "debited from": 1},
    "Paytm": {"paytm upi": 2, "paid successfully": 1},
    "Amazon": {"frequently bought together": 2, "deliver to": 1, "add to cart+buy now": 2, "fulfilled": 1},
    "Flipkart": {"flipkart assured": 2, "special price": 1, "bank offer": 1},
    "Myntra": {"add to bag+wishlist": 2, "myntra insider": 2},
    "Zomato": {"zomato gold": 2},
    "Swiggy": {"swiggy one": 2, "instamart": 1},
    "Spotify": {"liked songs": 2, "your library": 1, "now playing": 1},
    "Maps": {"directions": 1, "start navigation": 2, "avoid tolls": 2, "commute": 1, "your timeline": 2},
    "Netflix": {"new & hot": 2, "my list": 1, "continue watching": 1},
    "Play Store": {"about this app": 2, "data safety": 2, "ratings and reviews": 1, "install": 1},
    "IRCTC": {"chart prepared": 2, "pnr": 1, "berth": 1},
    "Truecaller": {"identified by truecaller": 2, "spam reports": 1},
    "Discord": {"message #": 2, "direct messages": 1},
}

# The lines that make a lock screen, and names for the screens without an app.
LOCK_DATE = r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday),? \d{1,2} [a-z]+$|^(mon|tue|wed|thu|fri|sat|sun),? [a-z]+ \d{1,2}$"
LOCK_CLOCK = r"^\d{1,2}[.:]\d{2}$"
LOCK_SCREEN, HOME_SCREEN = "Lock screen", "Home screen"

# Other names of apps.
APP_ALIASES = {
    "google chrome": "chrome", "chrome browser": "chrome", "google search": "google", "google app": "google", "gpay": "google pay", "g pay": "google pay",
    "twitter": "x", "x twitter": "x", "fb": "facebook", "insta": "instagram", "yt": "youtube", "whatsapp messenger": "whatsapp",
    "google play store": "play store", "google play": "play store", "gmail app": "gmail", "google mail": "gmail", "google maps": "maps",
    "google photos": "photos", "google drive": "drive", "google calendar": "calendar", "google messages": "messages", "phone pe": "phonepe",
}

# Names of known packages, and parts of a package that name nothing.
PACKAGE_NAMES = {
    "com.google.android.youtube": "YouTube", "com.instagram.android": "Instagram", "com.whatsapp": "WhatsApp", "com.whatsapp.w4b": "WhatsApp Business",
    "org.telegram.messenger": "Telegram", "com.android.chrome": "Chrome", "com.google.android.apps.maps": "Maps", "com.google.android.apps.nbu.paisa.user": "Google Pay",
    "com.phonepe.app": "PhonePe", "net.one97.paytm": "Paytm", "in.swiggy.android": "Swiggy", "com.application.zomato": "Zomato",
    "in.amazon.mShop.android.shopping": "Amazon", "com.flipkart.android": "Flipkart", "com.myntra.android": "Myntra", "com.netflix.mediaclient": "Netflix",
    "com.amazon.avod.thirdpartyclient": "Prime Video", "in.startv.hotstar": "Hotstar", "com.jio.media.ondemand": "JioCinema", "com.spotify.music": "Spotify",
    "com.twitter.android": "X", "com.facebook.katana": "Facebook", "com.snapchat.android": "Snapchat", "com.linkedin.android": "LinkedIn",
    "com.reddit.frontpage": "Reddit", "cris.org.in.prs.ima": "IRCTC", "com.makemytrip": "MakeMyTrip", "com.ubercab": "Uber", "com.olacabs.customer": "Ola",
    "com.google.android.gm": "Gmail", "com.google.android.apps.messaging": "Messages", "com.google.android.apps.photos": "Photos",
    "com.miui.home": "Home screen", "com.android.settings": "Settings",
}
PACKAGE_GENERIC = ("android", "app", "apps", "mobile", "client", "main", "lite", "com", "in", "org")

# Browsers.
BROWSER_LABELS = ("chrome", "firefox", "brave", "edge", "opera", "samsung internet", "internet", "duckduckgo", "vivaldi", "kiwi", "via", "uc browser", "browser", "mi browser", "jiosphere")
BROWSER_PACKAGES = ("com.android.chrome", "org.mozilla.firefox", "com.brave.browser", "com.microsoft.emmx", "com.opera.browser", "com.sec.android.app.sbrowser", "com.duckduckgo.mobile.android", "com.vivaldi.browser", "com.kiwibrowser.browser")

# The address bar's links, and endings that a link without a scheme may have.
PAGE_TOKEN = r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.([a-z]{2,12})(?::\d{2,5})?(?:/\S*)?$"
PAGE_ENDINGS = ("com", "in", "org", "net", "io", "co", "app", "dev", "me", "ai", "edu", "gov", "info", "xyz", "tv", "ly", "gl", "uk", "us", "ca", "au", "de", "fr", "jp", "community", "news", "blog", "shop", "store", "site", "page", "tech", "online", "live", "link", "so", "to", "gg", "fm", "be")

# Object labels that say nothing about a picture.
GENERIC_OBJECTS = ("mobile phone", "telephone", "screenshot", "text", "human face", "computer monitor", "display device")

# Entity patterns (classes and boundaries are ASCII).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
ENTITY_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "UPI": r"(?<![\w.@])[A-Za-z0-9][A-Za-z0-9._-]{1,63}@[A-Za-z]{2,32}(?![\w.@-])",
    "URL": r"(?i)(?<![@\w])(?:https?://|www\.)[^\s<>\"'`]+|(?<![@\w./])[a-z0-9][a-z0-9-]{1,62}(?:\.[a-z0-9-]{1,62})*\.(?:com|in|org|net|io|co|app|dev|me|ly|gl|tv|xyz|info|edu|gov|ai|shop|store|link)(?:/[^\s<>\"'`]*)?(?![\w@])",
    "CODE": r"(?i)\b(otp|one[- ]time password|verification code|security code|login code|code|pin)\b\D{0,20}?(?<!\d)(\d{4,8})(?!\d)",
    "AMOUNT": r"(?i)(?:₹|rs\.?|inr|\$|€|£)\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?(?:\s?/-)?|(?<![\w.])[0-9][0-9,]*(?:\.[0-9]{1,2})?\s?(?:/-|rupees|inr)(?!\w)",
    "PHONE": r"(?<![\w+])(?:\+?91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}(?!\d)|(?<![\w+])1800[\s-]?[0-9]{3}[\s-]?[0-9]{3,4}(?!\d)|\+[1-9][0-9]{0,2}[\s-]?\(?[0-9]{2,4}\)?[\s-]?[0-9]{3,4}[\s-]?[0-9]{3,4}(?!\d)",
    "ISO_DATE": r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)",
    "NUMERIC_DATE": r"(?<![\d/.-])(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?![\d/.-])",
    "DAY_MONTH": rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}\.?(?:[\s,'-]+(\d{{4}}|\d{{2}})(?![\d:]))?(?![a-z])",
    "MONTH_DAY": rf"(?i)(?<![a-z]){_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?!\d)(?:,?\s+(\d{{4}})(?![\d:]))?",
    "TIME": r"(?i)(?<![\d.:])(\d{1,2})[.:](\d{2})(?!\d)\s?(am|pm|a\.m\.|p\.m\.)?|(?<![\d.:])(\d{1,2})\s?(am|pm|a\.m\.|p\.m\.)",
}
QUERY_MONTH = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b(?:\s+(\d{4}))?"
QUERY_YEAR = r"\b(19|20)\d{2}\b"
