"""Word lists and patterns that cleaning and enrichment must share with the data's producers."""

# Words whose sentence isn't part of an article, in messages.
NON_ARTICLE = [
    "subscription", "subscribe", "comment", "comments", "create a display name", "Follow Al Jazeera English",
    "Sponsored", "edited by", "Sign up", "name", "email", "website", "news", "offer", "Email address", "Follow", "info",
    "Your bid", "proceed", "inbox", "receive", "Thank you for your report!", "Your daily digest", "Search", "Review",
    "Reviews", "Car Launches", "Driven Communications Sdn. Bhd.", "200801035597 (836938-P)", "Follow", "Email address",
    "Sign up", "For more of the latest", "subscribing", "2025 Hearst Magazines, Inc. .", "Connect", "enjoy", "love",
    "Best", "The Associated Press", "NBCUniversal Media, LLC", "Reporting by", "Contact", "ResearchAndMarkets.com",
    "Advertisement", "thank you",
]
# Further words of that kind, in scraped pages.
NON_ARTICLE_PAGES = [
    "Your daily digest of everything happening on the site. 2025 Bring a Trailer Media, LLC. .",
    "The materials provided on this Web site are for informational", "Cookies", "Connect With Us", "Back to top",
    "Comments have to be in English", "We have migrated to a new commenting platform", "Vuukle", "Patriots membership",
    "Become a Daily Caller Patriot today", "KicksOnFire.com", "F1technical", "Facebook", "Account", "Mediacorp 2025",
    "TouringPlans.com", "copyright", "Robb Report tote bag", "All below",
]
# Statements removed literally from scraped pages.
STATEMENTS = [
    "Search the news", "Personalise the news", "stay in the know", "Emergency", "Backstory", "Newsletters", "中文新闻",
    "BERITA BAHASA INDONESIA", "TOK PISIN",
]
# Words of questions and terms pages.
FAQ = [
    "faq", "frequently asked questions", "how to", "questions", "help", "contact us", "support", "terms and conditions",
    "privacy policy", "cookie policy", "all rights reserved", "disclaimer", "sitemap", "legal", "copyright",
]
# Legal phrases.
LEGAL = ["All Rights Reserved", "Privacy Policy", "Terms and Conditions", "Cookie Policy", "Disclaimer"]
# Families of sites by host, in order; the first that matches names the source type.
SOURCE_TYPES = [
    ("reuters|bloomberg|cnbc|wsj|nytimes|ft|forbes", "Major International News"),
    ("thestar|nst|theedge|malaymail|bernama", "Malaysian News"),
    ("finance|investor|market|business|investing|money", "Financial News"),
    ("energy|oil|gas|petroleum|offshore|rigzone|upstream", "Energy News"),
    ("blog|medium", "Blog"),
    ("gov|government", "Government"),
    ("edu|university|college|school", "Educational"),
    ("corp|company|inc|ltd|llc", "Corporate"),
]
# Outlets by a part of the address, in order.
OUTLETS = [
    ("reuters.com", "Reuters"), ("bloomberg.com", "Bloomberg"), ("nst.com", "New Straits Times"), ("thestar.com", "The Star"),
    ("theedgemarkets.com", "The Edge Markets"),
]
# Categories by words of the content, in order.
CATEGORIES = [
    ("financ|profit|revenue|earnings|dividend|investment|stock|market|shares", "Financial"),
    ("sustainab|green|environment|carbon|climate|emission|esg|renewable", "Sustainability"),
    ("gas|oil|drilling|exploration|discovery|field|reserves|lng|upstream|downstream|refinery", "Exploration & Production"),
    ("partner|deal|agreement|contract|acquisition|merger|joint venture|mou", "Business Deals"),
    ("technolog|digital|innovation|research|development|ai|platform", "Technology & Innovation"),
]
# Date formats, in order; the last one is that of the API.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MM-dd-yyyy",
    "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MMM dd, yyyy", "dd MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'",
]
# Words left out of topics besides the usual stop words.
TOPIC_STOP_WORDS = [
    "petronas", "said", "also", "year", "company", "group", "malaysia", "kuala", "lumpur", "ringgit", "rm", "mln", "bln",
    "pct", "news", "report", "update", "inc", "bhd",
]
# Tags and classes whose text isn't part of an article.
HTML_TAGS = ["footer", "aside", "nav", "form", "header", "script", "style", "noscript"]
HTML_CLASSES = [
    "subscription", "newsletter", "comments", "related-articles", "advertisement", "popup", "banner", "sponsored",
    "social-media", "more-articles", "alerts",
]
HTML_DIV_CLASSES = [
    "topic", "acknowledgment", "external-source", "time-zone", "multilingual", "search", "manage-alerts",
    "article-commenting", "breaking-news", "article-comments", "affiliate-links",
]
HTML_TEXTLESS = [
    "img", "picture", "figure", "figcaption", "video", "audio", "source", "track", "iframe", "embed", "object", "h1", "h2",
    "h3", "h4", "h5", "h6", "a", "ul", "ol", "li", "table", "thead", "tbody", "tr", "th", "td", "button", "svg", "canvas",
]
