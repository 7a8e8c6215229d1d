"""Word lists, character tables, patterns and sentences that define results.

Everything in this module is data. Changing any entry changes answers.
"""

# --- Fixed values: whitespace as Python's str.strip() and \s see it (Java's \s is ASCII only) ---
WHITESPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE_NOT_SPACE = WHITESPACE.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}")

# --- Fixed values: light search key (keyword matching) ---
SEARCH_MARKS = "ًٌٍَُِّْٰ"
SEARCH_LETTERS = {
    "أ": "ا",
    "إ": "ا",
    "آ": "ا",
    "ة": "ه",
    "ى": "ي",
}

# --- Fixed values: full normalization ---
DIACRITICS = "".join(map(chr, range(0x064B, 0x0660))) + "ٰـ"
FULL_LETTERS = {
    "أ": "ا",
    "إ": "ا",
    "آ": "ا",
    "ٱ": "ا",
    "ة": "ه",
    "ى": "ي",
    "ؤ": "و",
    "ئ": "ي",
}
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

# --- Fixed values: markup patterns ---
HANDLE_CHARS = r"A-Za-z0-9_\x{0621}-\x{064A}"
MENTION = rf"@([{HANDLE_CHARS}]{{2,30}})"
HASHTAG = rf"#([{HANDLE_CHARS}]{{2,50}})"
TAG_MARK = "\ue000"
STRAY_MARK = "\ue001"
HASHTAG_SIGN = rf"#(?=[{HANDLE_CHARS}]{{2}})"
UNDERSCORE_IN_TAG = rf"_(?<=\x{{E000}}[{HANDLE_CHARS}]{{1,50}})"
RETWEET_PREFIX = rf"^(?iu:RT)[{WHITESPACE}]+@[\p{{L}}\p{{N}}_]+:[{WHITESPACE}]*"
URL = rf"(?=[hHwW])(?iu:https?://[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+)"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}]+"
)
REPEATED_PUNCTUATION = r"([!\x{061F}?.])\1{2,}"
# Everything but Arabic, Arabic Supplement, a-z, A-Z, 0-9, whitespace and @ # _ . , ! ? : ' " -
# (spelled out: Java matches a listed class about eight times as fast as a negated one)
OUTSIDE_KEPT_CHARS = (
    r"[\x{0}-\x{8}\x{E}-\x{1B}\x{24}-\x{26}\x{28}-\x{2B}\x{2F}\x{3B}-\x{3E}\x{5B}-\x{5E}\x{60}"
    r"\x{7B}-\x{84}\x{86}-\x{9F}\x{A1}-\x{5FF}\x{700}-\x{74F}\x{780}-\x{167F}\x{1681}-\x{1FFF}"
    r"\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]"
)
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}]"
TOPIC_TOKEN = r"([\x{0600}-\x{06FF}a-z0-9]{2,})"
WORD = r"([\p{L}\p{N}_]{2,})"
ENTITY_START = r"&(#|[A-Za-z])"

# --- Fixed values: characters that NFC never changes and that never combine ---
NFC_SAFE = (
    r"\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{600}-\x{60F}\x{61B}-\x{64A}\x{660}-\x{66F}"
    r"\x{671}-\x{6D5}\x{750}-\x{77F}\x{2010}-\x{206F}\x{20A0}-\x{20CF}\x{2190}-\x{22FF}"
    r"\x{2500}-\x{2ADB}\x{3001}-\x{3029}\x{3041}-\x{3098}\x{4E00}-\x{9FFF}"
    r"\x{FE00}-\x{FE0F}\x{1F000}-\x{1FAFF}"
)
# The first range says again what the safe ones say, but lets Latin text go after one test.
NFC_MAYBE = rf"[\x{{300}}-\x{{10FFFF}}&&[^{NFC_SAFE}]]"
# Marks that the search normalization removes anyway only matter after three letters.
NFC_MAYBE_FOR_SEARCH = (
    rf"[\x{{300}}-\x{{10FFFF}}&&[^{NFC_SAFE}\x{{64B}}-\x{{65F}}\x{{670}}]]|[\x{{6C1}}\x{{6D2}}\x{{6D5}}][\x{{64B}}-\x{{65F}}\x{{670}}]*\x{{654}}"
)
# After cleaning only Arabic and ASCII are left: runs of marks, or marks that compose.
NFC_MAYBE_AFTER_CLEANING = (
    r"(?=[\x{610}-\x{6ED}])(?:[\x{610}-\x{61A}\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6ED}]{2}|[\x{653}-\x{655}])"
)

# --- Fixed values: sentiment lexicon ---
POSITIVE_WORDS = (
    "ممتاز", "رائع", "جميل", "أحب", "احب", "حلو", "مذهل", "تمام", "زين", "good", "great", "love",
)
NEGATIVE_WORDS = (
    "سيء", "سيئ", "أكره", "اكره", "زفت", "خايب", "فظيع", "مقرف", "bad", "hate", "terrible",
)

# --- Fixed values: stop words, as compared with normalized tokens ---
STOP_WORDS = (
    "في", "من", "الى", "إلى", "على", "عن", "مع", "هذا", "هذه", "ذلك", "ذلكم",
    "التي", "الذي", "الذين", "التى", "ما", "لا", "لن", "لم", "قد", "كل", "كما",
    "ثم", "او", "أو", "ام", "أم", "لكن", "انا", "أنا", "انت", "أنت", "نحن", "هم",
    "هي", "هو", "هما", "انتم", "أنتم", "كان", "كانت", "يكون", "تكون", "يا",
    "ايضا", "أيضا", "حتى", "عند", "لدى", "غير", "حول", "بين", "فقط", "جدا", "جداً",
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "i", "you",
    "he", "she", "we", "they", "it", "of", "to", "in", "on", "at", "with", "for",
)

# --- Fixed values: limits and defaults ---
MIN_CLEAN_CHARS = 8
MIN_ARABIC_CHARS = 3
MIN_POSTS = 20
POST_PREVIEW_CHARS = 200
NEAR_VOCABULARY = 10000
NEAR_THRESHOLD = 0.92
DEFAULT_DATASETS = ("ajgt", "arabic_sentiment_corpus", "metooma")

# --- Fixed values: report sentences ---
ARABIC_COMMA = "، "
ARABIC_AND = " و"
TONE_NAMES = {"positive": "إيجابية", "neutral": "محايدة", "negative": "سلبية"}
SUMMARY_EMPTY = "لم يتم العثور على بيانات كافية للتحليل."
SUMMARY_NO_KEYWORDS = "الموضوع المختار"
SUMMARY_COUNTS = "تحليل {posts} منشور حول {keywords} من {users} مصدر مختلف."
SUMMARY_TONE = (
    "النبرة العامة {tone} حيث بلغت المشاعر الإيجابية {pos}% والسلبية {neg}% والمحايدة {neu}%."
)
SUMMARY_TOPICS = "أبرز المحاور التي تكررت في النقاش هي: {topics}."
SUMMARY_INFLUENCER = "الحساب الأكثر تأثيراً هو {handle} بمؤشر تأثير {influence}."
ADVICE_FEW_POSTS = (
    "حجم البيانات محدود — يُنصح بتوسيع نطاق الكلمات المفتاحية أو "
    "إضافة datasets إضافية للحصول على نتائج أكثر تمثيلاً."
)
ADVICE_MAIN_TOPIC = "الموضوع الرئيسي"
ADVICE_NEGATIVE = (
    "المشاعر السلبية مرتفعة ({neg}%) — يُستحسن مراجعة "
    "النقاشات حول '{topic}' ومعالجة أسباب عدم الرضا."
)
ADVICE_POSITIVE = (
    "المشاعر الإيجابية مرتفعة ({pos}%) — استثمر هذا الزخم "
    "عبر حملات تسويقية تستند إلى الرسائل المحببة لدى الجمهور."
)
ADVICE_INFLUENCERS = "تواصل مع المؤثرين الأعلى تأثيراً ({handles}) لتعزيز الوصول والمصداقية."
ADVICE_FOCUS = "ركّز محتوى التواصل القادم على المحاور التالية: {topics}، فهي الأكثر اهتماماً لدى الجمهور."
ADVICE_TREND = "راقب اتجاه المشاعر عبر الزمن — التغيرات المفاجئة قد تشير إلى أحداث تستدعي استجابة سريعة."
ADVICE_DEFAULT = "استمر في رصد النقاش بانتظام للوقوف على التحولات في رأي الجمهور."
ERROR_NO_ROWS = "لم يتم جلب أي بيانات من المصادر المحددة."
ERROR_NO_VALID_ROWS = "لم تتبق بيانات صالحة بعد التنظيف."
ERROR_TOO_FEW = (
    "عدد المنشورات بعد الفلترة ({posts}) أقل من الحد الأدنى "
    "({minimum}). جرّب كلمات مفتاحية أوسع أو datasets إضافية."
)
ERROR_PREFIX = "فشل التحليل: "
NOTICE_TITLE = "اكتمل التحليل"
NOTICE_BODY = "تحليل '{title}' جاهز للمراجعة"
