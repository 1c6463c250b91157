"""Values fixed by the data formats and labels this library has to agree with."""

from __future__ import annotations

# ---- fixed values: merchant patterns, tried in this order, group 1 is the merchant ----
MERCHANT_PATTERNS = [
    r"UPI/(?:DR|CR)/\d+/([A-Za-z0-9 .&_]+?)/",
    r"UPI[-/]([A-Za-z0-9 .&_]+?)[-/]",
    r"POS[ /]\d*[ /]?([A-Za-z0-9 .&*_]+)",
    r"(?:NEFT|IMPS|RTGS)[-/ ][A-Z0-9]*[-/ ]?([A-Za-z0-9 .&_]+)",
]

# ---- fixed values: strptime formats tried when a profile's own format fails ----
FALLBACK_DATE_FORMATS = [
    "%d/%m/%Y",
    "%d/%m/%y",
    "%d-%m-%Y",
    "%d-%m-%y",
    "%Y-%m-%d",
    "%d %b %Y",
    "%d-%b-%Y",
    "%d %B %Y",
]

# ---- fixed values: chat export markers ----
INVISIBLE_MARKS = "\u200e\u200f\ufeff"
MEDIA_MARKERS = [
    "<media omitted>",
    "image omitted",
    "video omitted",
    "audio omitted",
    "sticker omitted",
    "gif omitted",
    "document omitted",
]
ATTACHMENT_PREFIX = "<attached:"

# ---- fixed values: activity labels ----
GYM_ACTIVITIES = ["strength_training", "gym", "weightlifting"]
ACTIVITY_ALIASES = {"gym": "strength_training", "weights": "strength_training"}

# ---- fixed values: header substring -> daily metrics column, first hit wins ----
DAILY_METRIC_HEADERS = [
    ("date", "day"),
    ("step", "steps"),
    ("distance", "distance_m"),
    ("calorie", "calories"),
    ("move minutes", "active_min"),
    ("active", "active_min"),
]

# ---- fixed values: threshold of a real listen ----
REAL_LISTEN_MS = 30000

# ---- fixed values: topic keywords, ties go to the earlier topic ----
TOPIC_KEYWORDS = {
    "color": ["color", "palette", "hex", "#", "rgb"],
    "chart": ["chart", "graph", "visualization", "trend", "bar", "pie", "scatter", "heatmap", "funnel"],
    "landing": ["landing", "page", "cta", "conversion", "hero", "testimonial", "pricing", "section"],
    "product": ["saas", "ecommerce", "e-commerce", "fintech", "healthcare", "gaming", "portfolio", "crypto", "dashboard"],
    "style": ["style", "design", "ui", "minimalism", "glassmorphism", "neumorphism", "brutalism", "dark mode", "flat", "aurora", "prompt", "css", "implementation", "variable", "checklist", "tailwind"],
    "ux": ["ux", "usability", "accessibility", "wcag", "touch", "scroll", "animation", "keyboard", "navigation", "mobile"],
    "typography": ["font", "typography", "heading", "serif", "sans"],
    "icons": ["icon", "icons", "lucide", "heroicons", "symbol", "glyph", "pictogram", "svg icon"],
    "react": ["react", "next.js", "nextjs", "suspense", "memo", "usecallback", "useeffect", "rerender", "bundle", "waterfall", "barrel", "dynamic import", "rsc", "server component"],
    "web": ["aria", "focus", "outline", "semantic", "virtualize", "autocomplete", "form", "input type", "preconnect"],
}
DEFAULT_TOPIC = "style"

# ---- fixed values: page type keywords, first list with a hit wins ----
PAGE_TYPES = [
    (["dashboard", "admin", "analytics", "data", "metrics", "stats", "monitor", "overview"], "Dashboard / Data View"),
    (["checkout", "payment", "cart", "purchase", "order", "billing"], "Checkout / Payment"),
    (["settings", "profile", "account", "preferences", "config"], "Settings / Profile"),
    (["landing", "marketing", "homepage", "hero", "home", "promo"], "Landing / Marketing"),
    (["login", "signin", "signup", "register", "auth", "password"], "Authentication"),
    (["pricing", "plans", "subscription", "tiers", "packages"], "Pricing / Plans"),
    (["blog", "article", "post", "news", "content", "story"], "Blog / Article"),
    (["product", "item", "detail", "pdp", "shop", "store"], "Product Detail"),
    (["search", "results", "browse", "filter", "catalog", "list"], "Search Results"),
    (["empty", "404", "error", "not found", "zero"], "Empty State"),
]
PAGE_TYPE_HINTS = [
    (["dashboard", "data"], "Dashboard / Data View"),
    (["landing", "marketing"], "Landing / Marketing"),
]
DEFAULT_PAGE_TYPE = "General"

# ---- fixed values: ranking parameters ----
BM25_K1 = 1.5
BM25_B = 0.75
SEARCH_K = 3
CORPUS_K = {"product": 1, "style": 3, "color": 2, "landing": 2, "typography": 2}
RERANK_WEIGHTS = {"name": 10, "keywords": 3, "other": 1}

# ---- fixed values: defaults of a recommendation ----
DEFAULT_RULE = {
    "pattern": "Hero + Features + CTA",
    "style_priority": ["Minimalism", "Flat Design"],
    "color_mood": "Professional",
    "typography_mood": "Clean",
    "key_effects": "Subtle hover transitions",
    "anti_patterns": "",
    "severity": "MEDIUM",
}
DEFAULT_CATEGORY = "General"
# Part of a recommendation: its corpus, the catalog column it comes from, its default.
RECOMMENDATION_PARTS = {
    "pattern_name": ("landing", "Pattern Name", None),
    "pattern_sections": ("landing", "Section Order", "Hero > Features > CTA"),
    "pattern_cta_placement": ("landing", "Primary CTA Placement", "Above fold"),
    "pattern_color_strategy": ("landing", "Color Strategy", ""),
    "pattern_conversion": ("landing", "Conversion Optimization", ""),
    "style_name": ("style", "Style Category", "Minimalism"),
    "style_type": ("style", "Type", "General"),
    "style_effects": ("style", "Effects & Animation", ""),
    "style_keywords": ("style", "Keywords", ""),
    "style_best_for": ("style", "Best For", ""),
    "style_performance": ("style", "Performance", ""),
    "style_accessibility": ("style", "Accessibility", ""),
    "color_primary": ("color", "Primary (Hex)", "#2563EB"),
    "color_secondary": ("color", "Secondary (Hex)", "#3B82F6"),
    "color_cta": ("color", "CTA (Hex)", "#F97316"),
    "color_background": ("color", "Background (Hex)", "#F8FAFC"),
    "color_text": ("color", "Text (Hex)", "#1E293B"),
    "color_notes": ("color", "Notes", ""),
    "font_heading": ("typography", "Heading Font", "Inter"),
    "font_body": ("typography", "Body Font", "Inter"),
    "font_mood": ("typography", "Mood/Style Keywords", None),
    "font_best_for": ("typography", "Best For", ""),
    "font_url": ("typography", "Google Fonts URL", ""),
    "font_css": ("typography", "CSS Import", ""),
}
# Catalog columns of the rules, in rule order.
RULE_COLUMNS = {
    "label": "UI_Category",
    "pattern": "Recommended_Pattern",
    "style_priority": "Style_Priority",
    "color_mood": "Color_Mood",
    "typography_mood": "Typography_Mood",
    "key_effects": "Key_Effects",
    "decision_rules": "Decision_Rules",
    "anti_patterns": "Anti_Patterns",
    "severity": "Severity",
}

# ---- fixed values: catalog files and the columns searched, per corpus ----
CATALOGS = {
    "style": ("styles.csv", ["Style Category", "Keywords", "Best For", "Type", "AI Prompt Keywords"]),
    "color": ("colors.csv", ["Product Type", "Notes"]),
    "chart": ("charts.csv", ["Data Type", "Keywords", "Best Chart Type", "Accessibility Notes"]),
    "landing": ("landing.csv", ["Pattern Name", "Keywords", "Conversion Optimization", "Section Order"]),
    "product": ("products.csv", ["Product Type", "Keywords", "Primary Style Recommendation", "Key Considerations"]),
    "ux": ("ux-guidelines.csv", ["Category", "Issue", "Description", "Platform"]),
    "typography": ("typography.csv", ["Font Pairing Name", "Category", "Mood/Style Keywords", "Best For", "Heading Font", "Body Font"]),
    "icons": ("icons.csv", ["Category", "Icon Name", "Keywords", "Best For"]),
    "react": ("react-performance.csv", ["Category", "Issue", "Keywords", "Description"]),
    "web": ("web-interface.csv", ["Category", "Issue", "Keywords", "Description"]),
}
STACKS = [
    "html-tailwind", "react", "nextjs", "astro", "vue", "nuxtjs", "nuxt-ui", "svelte", "swiftui",
    "react-native", "flutter", "shadcn", "jetpack-compose",
]
STACK_COLUMNS = ["Category", "Guideline", "Description", "Do", "Don't"]

# ---- fixed values: page layout classes by keyword of the best style ----
LAYOUT_CLASSES = [
    (["data", "dense", "dashboard", "grid"], "1400px or full-width", "12-column grid for data flexibility", "High — optimize for information display"),
    (["minimal", "simple", "clean", "single"], "800px (narrow, focused)", "Single column, centered", "Low — focus on clarity"),
]
STANDARD_LAYOUT = ("1200px (standard)", "Full-width sections, centered content")
PLAIN_LAYOUT = ("1200px", "Responsive grid")
DEFAULT_ADVICE = [
    "Refer to MASTER.md for all design rules",
    "Add specific overrides as needed for this page",
]

# ---- fixed values: caps ----
DEFAULT_ROW_CAP = 500
VOCABULARY_CAP = 50
HEADER_SCAN_LINES = 30
