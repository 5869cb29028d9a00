"""Word lists that results depend on. All of them are fixed values; pass others where a parameter allows."""

# Social networks, directories and platforms whose links name no client.
BOILERPLATE_DOMAINS = (
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com",
    "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com",
    "snapchat.com", "reddit.com", "threads.net", "vimeo.com", "tumblr.com",
    "whatsapp.com", "telegram.org", "medium.com", "substack.com", "yelp.com",
    "nextdoor.com", "glassdoor.com", "indeed.com", "angi.com", "angieslist.com",
    "houzz.com", "thumbtack.com", "bbb.org", "trustpilot.com", "g2.com",
    "capterra.com", "crunchbase.com", "producthunt.com",
    "clutch.co", "sortlist.com", "designrush.com", "upcity.com",
    "agencyspotter.com", "goodfirms.co", "themanifest.com", "expertise.com",
    "agencyvista.com", "partners.tiktok.com", "business.tiktok.com",
    "google.com", "googleapis.com", "gstatic.com", "googletagmanager.com",
    "google-analytics.com", "googleadservices.com", "doubleclick.net",
    "youtube-nocookie.com", "recaptcha.net", "cloudflare.com", "cloudfront.net",
    "jsdelivr.net", "unpkg.com", "bootstrapcdn.com", "fontawesome.com",
    "typekit.net", "fonts.net", "amazonaws.com", "akamaized.net", "imgix.net",
    "wp.com", "wordpress.com", "wordpress.org", "wpengine.com", "kinsta.com",
    "siteground.com", "godaddy.com", "wix.com", "squarespace.com", "webflow.com",
    "webflow.io", "shopify.com", "myshopify.com", "hubspot.com", "hubspotusercontent.com",
    "mailchimp.com", "klaviyo.com", "activecampaign.com", "calendly.com",
    "hotjar.com", "segment.com", "intercom.com", "drift.com", "zendesk.com",
    "typeform.com", "airtable.com", "notion.so", "github.com", "gitlab.com",
    "apple.com", "microsoft.com", "adobe.com", "salesforce.com", "zoom.us",
    "vercel.app", "netlify.app", "herokuapp.com", "gravatar.com", "w3.org",
    "schema.org", "creativecommons.org", "adobe.io", "stripe.com", "paypal.com",
    "semrush.com", "ahrefs.com", "moz.com", "similarweb.com", "builtwith.com",
)

# Labels that are page chrome.
JUNK_LABELS = (
    "", "logo", "logos", "client logo", "client logos", "clients", "client",
    "image", "img", "photo", "picture", "icon", "banner", "background", "bg",
    "arrow", "star", "stars", "quote", "divider", "spacer", "placeholder",
    "thumbnail", "thumb", "avatar", "profile", "header", "footer", "menu",
    "search", "close", "play", "pause", "next", "previous", "prev", "read more",
    "learn more", "view case study", "case study", "see the work", "view work",
    "our work", "portfolio", "home", "about", "about us", "contact", "contact us",
    "services", "blog", "news", "careers", "privacy policy", "terms",
    "facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok",
    "pinterest", "snapchat", "google", "google partner", "meta business partner",
    "clutch", "clutch reviews", "trustpilot", "certified", "badge", "award",
    "sitemap", "find us", "shop now", "get a quote", "free audit", "testimonial",
    "testimonials", "team", "our team", "results", "case studies",
)

# Words of image file names that name nobody.
FILENAME_NOISE = (
    "logo", "logos", "logotype", "wordmark", "icon", "brand", "branding",
    "client", "clients", "customer", "partner", "color", "colour", "colored",
    "bw", "b-w", "grey", "gray", "greyscale", "grayscale", "white", "black",
    "dark", "light", "mono", "monochrome", "transparent", "trans", "alpha",
    "final", "new", "old", "copy", "v1", "v2", "v3", "small", "med", "medium",
    "large", "sm", "md", "lg", "xl", "thumb", "thumbnail", "hover", "active",
    "web", "webp", "png", "jpg", "jpeg", "svg", "gif", "retina", "hd", "min",
    "cropped", "resized", "scaled", "edit", "edited", "featured", "img", "image",
    "site", "header", "footer", "square", "horizontal", "vertical", "stacked",
    "primary", "secondary", "alt", "default", "placeholder",
)

# File names of credentials and reviews, folders of theme images, folders of logos.
BADGE_WORDS = (
    "badge", "award", "certified", "certification", "accredit", "partner-badge",
    "google-partner", "meta-business", "premier", "review", "rating", "seal",
    "trusted", "verified", "member", "association", "bbb", "inc5000", "top-",
)
THEME_PATHS = (
    "/themes/", "/theme/", "/plugins/", "/icons/", "/icon/",
    "/flags/", "/emoji/", "/fonts/", "/sprite", "/ui/", "/svg/icons",
)
LOGO_PATHS = (
    "/uploads/", "/wp-content/", "/media/", "/assets/", "/images/",
    "/img/", "/logos/", "/logo/", "/clients/", "/client/",
    "/brands/", "/files/", "/storage/", "/static/",
)

# Traces of pages that are drawn by scripts, and of walls against robots.
JS_MARKERS = (
    "enable javascript", "please enable js", "__next_data__", "data-reactroot",
    'id="root"', "id='root'", 'id="app"', "id='app'", "ng-app", "v-app",
    "data-v-app", "webpack", ".bundle.js", "chunk.js", "swiper-container",
    "owl-carousel", "slick-slider", "elementor-loop", "wp-block-query",
    "data-elementor-type", "vue.js", "react-dom", "gatsby", "nuxt",
)
WALL_MARKERS = (
    "just a moment", "checking your browser", "cf-browser-verification",
    "enable javascript and cookies to continue", "attention required! | cloudflare",
    "px-captcha", "captcha-delivery", "unusual traffic from your computer network",
    "our systems have detected unusual traffic",
)

# Address words of client pages.
CLIENT_URL_WORDS = (
    "client", "work", "case-stud", "casestud", "portfolio", "result",
    "who-we-work", "project", "success-stor", "customer", "testimonial",
    "our-brands", "brands",
)

# Holding companies and networks.
NETWORK_NAMES = (
    "wpp", "omnicom", "publicis", "dentsu", "interpublic", "ipg", "havas",
    "accenture", "accenture song", "deloitte", "deloitte digital", "pwc", "ey",
    "kpmg", "mccann", "ogilvy", "vmly&r", "vml", "wunderman", "grey", "ddb",
    "bbdo", "tbwa", "leo burnett", "saatchi", "razorfish", "sapient",
    "publicis sapient", "digitas", "starcom", "zenith", "mindshare", "mediacom",
    "wavemaker", "essence", "initiative", "ubm", "isobar", "merkle", "iprospect",
    "horizon media", "group m", "groupm", "hearts & science", "carat",
)

# Words that carry no identity in a merge key.
KEY_NOISE = ("the", "inc", "llc", "ltd", "co", "corp", "company", "group", "and")

# Ad-tag signatures by platform, label and pattern (case matters where marked).
SIGNATURES = (
    ("tiktok", "events.js loader", r"(?i)analytics\.tiktok\.com/i18n/pixel/events\.js"),
    ("tiktok", "ttq.load", r"(?i)\bttq\s*\.\s*load\s*\("),
    ("tiktok", "ttq.page/track", r"(?i)\bttq\s*\.\s*(page|track|identify)\s*\("),
    ("tiktok", "pixel endpoint", r"(?i)analytics\.tiktok\.com/api/v\d+/pixel"),
    ("tiktok", "gtm template", r"(?i)tiktok[_-]?(pixel|ads|conversion)"),
    ("meta", "fbevents.js loader", r"""(?i)connect\.facebook\.net/[^/"']+/fbevents\.js"""),
    ("meta", "fbq init", r"""(?i)\bfbq\s*\(\s*['"]init['"]"""),
    ("meta", "tr pixel", r"(?i)facebook\.com/tr\?id="),
    ("meta", "pixel id", r"""(?i)\bfbq\s*\(\s*['"]init['"]\s*,\s*['"](\d{15,16})['"]"""),
    ("google_ads", "gtag AW loader", r"(?i)googletagmanager\.com/gtag/js\?id=AW-"),
    ("google_ads", "conversion id", r"\bAW-\d{9,11}\b"),
    ("google_ads", "googleadservices", r"(?i)googleadservices\.com/pagead/conversion"),
    ("google_ads", "doubleclick remarketing", r"(?i)googleads\.g\.doubleclick\.net"),
    ("google_ads", "legacy conversion", r"(?i)google_conversion_id"),
    ("floodlight", "fls.doubleclick", r"(?i)[\w.-]*\bfls\.doubleclick\.net"),
    ("floodlight", "dc_ tags", r"(?i)\bdc_(iu|rdid|pre)\b"),
    ("pinterest", "pintrk", r"(?i)\bpintrk\s*\("),
    ("pinterest", "pinterest tag", r"(?i)s\.pinimg\.com/ct/core\.js"),
    ("snapchat", "snaptr", r"(?i)\bsnaptr\s*\("),
    ("snapchat", "sc-static", r"(?i)sc-static\.net/scevent\.min\.js"),
)
PLATFORMS = ("tiktok", "meta", "google_ads", "floodlight", "pinterest", "snapchat")

# Other channels, by the words that name them.
CHANNELS = (
    ("meta", r"(?i)\b(meta ads|facebook ads|instagram ads|meta advertising|facebook advertising|paid social)\b"),
    ("youtube", r"(?i)\b(youtube ads|youtube advertising|youtube|yt shorts)\b"),
    ("google", r"(?i)\b(google ads|google advertising|adwords|paid search|sem)\b"),
    ("reels", r"(?i)\b(reels|short-?form video|vertical video)\b"),
)
