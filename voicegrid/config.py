"""Settings and the fixed values the analysis depends on."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: lexicons, weights, labels, patterns and lookup tables that
# --- define the results. They are data, so callers can replace any of them.

POSITIVE_WORDS = ("good", "great", "excellent", "love", "best", "amazing", "useful", "easy")
NEGATIVE_WORDS = ("bad", "worst", "hate", "crash", "broken", "slow", "issue", "problem", "bug")

CATEGORY_LABELS = ("Bug", "Complaint", "Feature Request", "Performance Issue", "Praise", "UI Issue")
ISSUE_CATEGORIES = ("Bug", "Performance Issue", "Complaint", "UI Issue")
RATE_CATEGORIES = ("Feature Request", "Bug", "Performance Issue", "UI Issue", "Complaint")

CATEGORY_WEIGHTS = {
    "Bug": 4.0,
    "Performance Issue": 3.5,
    "Complaint": 3.0,
    "UI Issue": 2.5,
    "Feature Request": 2.0,
    "Praise": 0.5,
}
OTHER_CATEGORY_WEIGHT = 1.0

TOPIC_PATTERNS = {
    "Advertisements": r"\b(ad|ads|advertisement|advertisements|too many ads|ad break)\b",
    "Subscription pricing": r"\b(subscription|premium (price|cost)|pricing|too expensive|monthly (fee|price))\b",
    "Playback performance": r"\b(buffering|buffer|loading (slow|issue)|slow loading|playback (issue|problem)|video (not )?play)\b",
    "Offline downloads": r"\b(download (fail|issue|problem)|offline (download|mode|view)|cannot download)\b",
    "Login and account access": r"\b(log ?in|sign ?in|cannot access|account (locked|suspended|problem))\b",
    "Payment and billing": r"\b(payment|billing|charged|refund|transaction)\b",
    "Crashes and stability": r"\b(crash|crashes|crashing|keeps stopping|force close)\b",
    "Search and discovery": r"\b(search (feature|function|result|bar)|cannot find|find (video|music|content))\b",
    "Recommendations": r"\b(recommendation|recommend(ed|ing)|suggestion|algorithm)\b",
    "UI and navigation": r"\b(user interface|ui |navigation|layout|design|hard to (use|navigate))\b",
    "Notifications": r"\b(notification|notifications|alert|alerts)\b",
    "Casting and TV": r"\b(cast(ing)?|chromecast|smart tv|tv app)\b",
    "Background playback": r"\b(background play|play in background|screen off)\b",
    "Audio synchronization": r"\b(audio.*(sync|delay)|sound.*(sync|delay)|out of sync)\b",
}

CALIBRATION_THRESHOLDS = (0.50, 0.60, 0.65, 0.70, 0.80, 0.90, 0.95)

# Confidence histogram: upper edge (closed) of each bin and its label.
CONFIDENCE_BINS = (
    (0.5, "0.00-0.49"),
    (0.6, "0.50-0.59"),
    (0.7, "0.60-0.69"),
    (0.8, "0.70-0.79"),
    (0.9, "0.80-0.89"),
    (1.00001, "0.90-1.00"),
)

# App name -> store id, confirmed by hand.
VERIFIED_APP_IDS = {
    "facebook": "com.facebook.katana",
    "instagram": "com.instagram.android",
    "spotify": "com.spotify.music",
    "google pay": "com.google.android.apps.nbu.paisa.user",
    "gpay": "com.google.android.apps.nbu.paisa.user",
    "swiggy": "in.swiggy.android",
    "amazon": "in.amazon.mShop.android.shopping",
    "flipkart": "com.flipkart.android",
    "youtube": "com.google.android.youtube",
    "zomato": "com.application.zomato",
    "microsoft teams": "com.microsoft.teams",
    "linkedin": "com.linkedin.android",
    "canva": "com.canva.editor",
    "uber": "com.ubercab",
    "duolingo": "com.duolingo",
    "paytm": "net.one97.paytm",
    "notion": "notion.id",
    "phonepe": "com.phonepe.app",
}

# Competitor name (case-folded) -> store id, confirmed by hand.
VERIFIED_COMPETITOR_IDS = {
    "tiktok": "com.zhiliaoapp.musically",
    "snapchat": "com.snapchat.android",
    "facebook": "com.facebook.katana",
    "youtube music": "com.google.android.apps.youtube.music",
    "amazon music": "com.amazon.mp3",
    "jiosaavn": "com.jio.media.jiobeats",
    "slack": "com.Slack",
    "zoom": "us.zoom.videomeetings",
    "google meet": "com.google.android.apps.tachyon",
    "lyft": "me.lyft.android",
    "phonepe": "com.phonepe.app",
    "paytm": "net.one97.paytm",
    "flipkart": "com.flipkart.android",
    "myntra": "com.myntra.android",
    "zomato": "com.application.zomato",
    "swiggy": "in.swiggy.android",
    "linkedin": "com.linkedin.android",
    "indeed": "com.indeed.android.jobsearch",
    "evernote": "com.evernote",
    "microsoft onenote": "com.microsoft.office.onenote",
    "duolingo": "com.duolingo",
    "canva": "com.canva.editor",
    "adobe express": "com.adobe.spark.post",
    "figma": "com.figma.mirror",
    "disney+": "com.disney.disneyplus",
    "instagram reels": "com.instagram.android",
}

COMPETITOR_NOTES = {
    "instagram reels": "Reels is a feature within Instagram; comparison uses Instagram reviews.",
}

# App name -> competitors in order of preference.
COMPETITORS = {
    "spotify": ("YouTube Music", "Apple Music", "Amazon Music", "JioSaavn", "Gaana"),
    "microsoft teams": ("Slack", "Zoom", "Google Meet", "Cisco Webex"),
    "instagram": ("TikTok", "Snapchat", "Facebook"),
    "facebook": ("Instagram", "TikTok", "Snapchat"),
    "youtube": ("Netflix", "Disney+", "Instagram Reels"),
    "uber": ("Ola", "Lyft", "Rapido"),
    "gpay": ("PhonePe", "Paytm", "Amazon Pay"),
    "phonepe": ("Google Pay", "Paytm", "Amazon Pay"),
    "paytm": ("PhonePe", "Google Pay", "Amazon Pay"),
    "flipkart": ("Amazon", "Myntra", "Meesho"),
    "amazon": ("Flipkart", "eBay", "Walmart"),
    "swiggy": ("Zomato", "Blinkit", "Zepto"),
    "zomato": ("Swiggy", "Blinkit", "Zepto"),
    "linkedin": ("Indeed", "Naukri", "Glassdoor"),
    "notion": ("Evernote", "Microsoft OneNote", "ClickUp"),
    "duolingo": ("Babbel", "Busuu", "Memrise"),
    "canva": ("Adobe Express", "Figma", "VistaCreate"),
}

# Apps of the bulk collection.
BULK_APPS = {
    "instagram": "com.instagram.android",
    "spotify": "com.spotify.music",
    "gpay": "com.google.android.apps.nbu.paisa.user",
    "swiggy": "in.swiggy.android",
    "amazon": "in.amazon.mShop.android.shopping",
    "flipkart": "com.flipkart.android",
    "youtube": "com.google.android.youtube",
    "zomato": "com.application.zomato",
    "Microsoft Teams": "com.microsoft.teams",
    "LinkedIn": "com.linkedin.android",
    "Canva": "com.canva.editor",
    "Uber": "com.ubercab",
    "Duolingo": "com.duolingo",
    "Paytm": "net.one97.paytm",
    "Notion": "notion.id",
    "PhonePe": "com.phonepe.app",
}

STORE_PAGE_URL = "https://play.google.com/store/apps/details?id="
REVIEW_SOURCE = "play_store"
CLEAN_CORPUS_SOURCE = "playstore"
EMBEDDING_WIDTH = 384


@dataclass(frozen=True)
class Settings:
    """Thresholds and word lists of one analysis; pass a changed copy to alter them."""

    review_count: int = 1000
    bulk_review_count: int = 7000
    max_competitors: int = 3
    classification_threshold: float = 0.60
    dedupe_threshold: float = 0.90
    feature_limit: int = 10
    theme_limit: int = 5
    evidence_limit: int = 6
    evidence_question: str = "%s competitors product features release notes"
    evidence_stopwords: tuple[str, ...] = ()
    override_batch_rows: int = 100
    positive_words: tuple[str, ...] = POSITIVE_WORDS
    negative_words: tuple[str, ...] = NEGATIVE_WORDS
    topic_patterns: dict[str, str] = field(default_factory=lambda: dict(TOPIC_PATTERNS))
    category_weights: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))


DEFAULTS = Settings()
