"""Word lists. All lists are fixed values that results depend on, kept as plain text.

Larger vocabularies are passed to the operators as a dict or read from a
``(category, term)`` table by :func:`read_lexicon`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def words(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def phrases(text: str) -> list[str]:
    return list(dict.fromkeys(p.strip() for p in text.split("|")))


# --- stop words -------------------------------------------------------------------

ARABIC_STOP = words(
    "في من إلى على هذا هذه أن كان كانت ليس لكن أو ثم أي كل التي الذي الذين أنه أنها ذلك تلك قد لقد حتى عبر مع بعد "
    "قبل خلال بين عن هو هي نحن هم هن منذ حيث كيف متى أين لم لن إذا ما لا بل كذلك بعض جميع frente"
)
KEYWORD_STOP = words(
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did "
    "will would could should may might must can this that these those i you he she it we they me him her us them my "
    "your his its our their "
    "ال في على من إلى مع عن هذا هذه ذلك تلك التي الذي اللذين اللواتي ما كيف متى أين لماذا "
    "le la les un une des et ou mais dans sur à de du pour avec par ce cette ces qui que dont où quand comment pourquoi"
)
ENGLISH_MARKERS = words(
    "the a an and or of to in is it that for on with as was are be been this that these those not at by from you we "
    "they he she his her their our your my i me him them us"
)
FRENCH_MARKERS = words(
    "le la les un une des et ou de du au aux en que qui est pas pour sur avec sans dans par ce cet cette ces mon ma mes "
    "son sa ses etre avoir faire dire il elle nous vous ils elles a et y l"
)
GERMAN_MARKERS = words("der die das und ist nicht ein eine mit auf für von den dem des sich auch aus bei nach wie zu im")
SPANISH_MARKERS = words("el los las una y del que es no con para por como su lo más pero sus al en se este esta")

# --- sentiment --------------------------------------------------------------------

POSITIVE = words(
    "good great excellent positive happy joy love like amazing wonderful best better fantastic terrific outstanding "
    "superb nice perfect brilliant awesome نجاح فوز تطور إيجابي سعيد ممتاز جيد ازدهار انتصار"
)
NEGATIVE = words(
    "bad terrible awful negative sad unhappy hate dislike horrible worst worse disaster fail failure poor weak sick "
    "ill wrong error problem issue broken damage crash kill die dead war conflict فشل خسارة كارثة سيء أسوأ حرب صراع "
    "موت تدمير أزمة"
)
MULTI_POSITIVE = words(
    "good great excellent positive success win victory happy joy love best amazing wonderful fantastic beautiful "
    "perfect outstanding brilliant superb magnificent جيد ممتاز إيجابي نجاح فوز انتصار سعيد فرح حب أفضل رائع مذهل "
    "جميل مثالي بارز متميز bon positif succès victoire heureux joie amour meilleur incroyable merveilleux "
    "fantastique beau parfait exceptionnel"
)
MULTI_NEGATIVE = words(
    "bad terrible awful negative fail failure loss sad angry hate worst horrible disgusting poor disappointing "
    "devastating tragic crisis disaster سيء فظيع مروع سلبي فشل خسارة حزين غاضب كره أسوأ مقزز رديء مخيب مدمر مأساوي "
    "أزمة كارثة mauvais affreux négatif échec perte triste haine pire dégoûtant pauvre décevant dévastateur tragique "
    "crise catastrophe"
)
PREFIX_POSITIVE = words(
    "ممتاز رائع جيد إيجابي سعيد فرح حب نجاح ناجح انتصار فوز تطور تقدم إنجاز أمل سلام أمان استقرار احتفال تكريم جائزة "
    "افتتاح إطلاق تعاون شراكة شراكات ازدهار نمو خير بركة مساعدة دعم توافق اتفاق اتفاقية حل إصلاح تحسين ارتفاع زيادة "
    "قوي قوة نهضة شكر ترحيب إشادة تتويج تميز تفوق أفضل مكسب ارتقاء بناء مذهل جميل مفيد مثالي تحدي إبداعي مميز فريد "
    "سليم صحي آمن مستقر مطمئن مشرق واعد منشود مرغوب محبوب مقبول سهل بسيط ميسر عظيم كريم مهم "
    "good great excellent positive happy joy love like amazing wonderful best better fantastic terrific outstanding "
    "superb nice fine perfect brilliant awesome cool sweet lovely success win victory achieve progress improve growth "
    "benefit hope peace safe secure celebrate honor award launch new"
)
PREFIX_NEGATIVE = words(
    "سيئ فظيع سلبي حزين كره كارثة فشل فقر مرض أمراض خطأ مشكلة أزمة أزمات خراب ضرر أضرار حادث حوادث قتل موت وفاة "
    "وفيات مقتل اغتيال حرب حروب صراع هجوم اعتداء انهيار خسارة خسائر خطر مخاطر تهديد عنف جريمة جرائم فساد فضيحة "
    "فضائح احتجاج احتجاجات توتر خوف قلق أذى اعتقال إدانة إصابة إصابات ضحية ضحايا إرهاب إرهابي تدمير نزيف معاناة "
    "شكوى سيء مؤسف مخيف خطير اصابة مصاب دمار تلوث وباء كوارث غش تجاوز انتهاك قمع ظلم تعذيب مخيب محبط مرفوض صعب "
    "مستحيل مشاكل bad terrible awful negative sad unhappy hate horrible worst worse disaster fail failure poor sick "
    "ill wrong error problem issue broken damage crash kill die dead war conflict attack bomb crisis collapse loss "
    "danger risk threat violence crime corruption scandal protest tension fear"
)
NEGATORS = words("لا ليس ليست لم لن ما غير بدون لايزال")
WEIGHTED_SENTIMENT = {
    "فوز": 1.0, "ربح": 1.0, "نجاح": 1.0, "تقدم": 0.8, "إنجاز": 1.0, "win": 1.0, "victory": 1.0, "success": 1.0,
    "growth": 0.8, "expansion": 0.8, "اتفاق": 0.7, "إطلاق": 0.6, "تحسين": 0.7, "تطوير": 0.7, "جديد": 0.5, "أفضل": 0.8,
    "رائع": 0.9, "ممتاز": 1.0, "إيجابي": 0.8, "متفائل": 0.9, "فرصة": 0.6, "مستقبل": 0.5, "أمل": 0.7, "ريادة": 0.8,
    "تميز": 0.9, "خسارة": -1.0, "فشل": -1.0, "خسائر": -1.0, "انهيار": -1.0, "أزمة": -0.9, "loss": -1.0,
    "failure": -1.0, "crisis": -0.9, "inflation": -0.7, "decline": -0.8, "رفض": -0.7, "احتجاج": -0.8, "صراع": -0.8,
    "خطر": -0.9, "تهديد": -0.9, "أسوأ": -0.9, "سيء": -0.7, "سلبي": -0.8, "متشائم": -0.7, "مخيف": -0.9, "تراجع": -0.7,
    "كارثة": -1.0, "فاجعة": -1.0,
}

# --- headline and title rules -------------------------------------------------------

SENSATIONAL = phrases(
    "shocking|shock|amazing|incredible|unbelievable|miracle|secret|hidden|exposed|revealed|scandal|outrage|furious|"
    "devastating|tragic|horrific|stunning|jaw-dropping|mind-blowing|صادم|مذهل|غريب|مفاجئ|فضيحة|غضب|مأساة|مروّع|"
    "choquant|incroyable|révélé|scandale"
)
CLICKBAIT = phrases(
    "you won't believe|what happened next|this is why|the truth about|shocking truth|you need to see|"
    "will change your life|never seen before|breaking now|لا تصدق|ماذا حدث بعد ذلك|هذه هي الحقيقة|الحقيقة الصادمة|"
    "غيرت حياتك|لم يسبق له مثيل|عاجل الآن|vous ne croirez pas|la vérité sur|choquant|incroyable"
)
ABSOLUTES = phrases(
    "always|never|all|every|none|nobody|everybody|tous|jamais|rien|personne|tout le monde|constamment|toujours"
)
SPAM_PATTERNS = (
    r"[!?؟]{3,}",
    r"(صدم|صاعق|لا يصدق|Чем|سينفعك|سيغير|الحقيقة|ما لم يخبرك|ما لا تعرفه)",
    r"\d+[.\-]\s*.*?\d+[.\-]\s*.*?\d+",
    r"(الله أكبر|الفتنة|المؤامرة|اليهود|الصهيون|الغنائم)",
)
GENERIC_TITLES = phrases(
    "news|latest|breaking|home|accueil|principal|politics|politique|sport|sports|économie|economy|business|"
    "international|world|monde|technology|technologie|culture|health|santé|science|science et technologie|regions|"
    "régions|local|national|faits divers|société|society"
)
SITE_TITLES = phrases(
    "al jazeera|الجزيرة|bbc|cnn|reuters|le monde|hespress|mosaique fm|almasryalyoum|google|facebook|twitter|instagram|"
    "youtube|whatsapp|telegram"
)
SITE_TITLES_WIDE = SITE_TITLES + phrases("alaraby|alarabiya|sky news|france 24|dw|dw.com|ap news|associated press|afp")
PUBLISHER_SUFFIXES = phrases(
    "اليوم 24|اليوم24|اليوم|جريدة المنتخب|المنتخب|جريدة|صحيفة|هسبريس|هبة بريس|لي360|le360|كووورة|kora|الجزيرة|"
    "alarabiya|العربية|سكاي نيوز|reuters|bbc|cnn|al jazeera|ap news|associated press"
)
PUBLISHER_TITLES = PUBLISHER_SUFFIXES + phrases("lematin|lematin.ma|telquel|aujourdhui")
CATEGORY_LABELS = phrases(
    "الأخبار|الرياضة|الاقتصاد|السياسة|الثقافة|التكنولوجيا|الصحة|العالم|المغرب|العربي|دولي|محلي|faits divers|actus|"
    "actualités|actualite|news|info|infos"
)
BOILERPLATE = phrases(
    "cookie|cookies|politique de confidentialité|privacy policy|mentions légales|terms of service|"
    "conditions générales|about us|à propos|contactez-nous|contact us|newsletter|inscrivez-vous|subscribe|abonnement|"
    "publicité|advertisement|sponsored|contenu sponsorisé|rejoignez-nous|follow us|suivez-nous|téléchargez notre|"
    "application mobile|app store|google play|all rights reserved|tous droits réservés|copyright|droits d’auteur|"
    "powered by"
)
SECTION_URL_WORDS = phrases(
    "category|categorie|categoría|section|rubrique|rubriques|tag|tags|étiquette|étiquettes|mot-clé|mot-cles|search|"
    "recherche|buscar|suche|archive|archives|author|auteur|publisher|about|contact|privacy|cookie|terms|condition|"
    "sitemap|rss|feed|newsletter|video|vidéo|videos|vidéos|watch|live|direct|photo|photos|gallery|gallerie|album|"
    "infographic|opinion|éditorial|editorial|letters|corrections|weather|météo|horoscope|lottery|loto"
)
SECTION_WORDS = words(
    "الأخبار أخبار تقنية تكنولوجيا اقتصاد اقتصادية أعمال سياسة رياضة فن ثقافة منوعات عالم دولي محليات محلي صحة علوم "
    "سفر سياحة ألعاب تعليم حوادث ميديا فيديو صور عاجل حصري رأي مقالات تحقيقات البطولات بطولات العالم الدوري كأس كرة "
    "قدم سلة الكورة كورة مباراة مباريات فريق فريقين لاعب لاعبين news sports business tech technology world health "
    "science culture entertainment opinion analysis review lifestyle travel fashion food finance economy league "
    "tournament cup match team player score"
)
PRESS_SECTION_WORDS = words(
    "الأخبار أخبار تقنية تكنولوجيا اقتصاد اقتصادية أعمال سياسة رياضة فن ثقافة منوعات عالم دولي محليات محلي صحة علوم "
    "سفر سياحة ألعاب تعليم حوادث ميديا فيديو صور عاجل حصري رأي مقالات تحقيقات البطولات بطولات الدوري كأس أسود news "
    "sports business tech technology world health science culture entertainment opinion analysis review lifestyle "
    "travel fashion food finance economy league tournament cup match standings"
)
NON_NEWS_TITLES = phrases(
    "الأخبار التقنية|الأخبار الاقتصادية|الأخبار الرياضية|الأخبار السياسية|الأخبار العامة|الأخبار المحلية|"
    "الأخبار العالمية|الأخبار|أخبار|تقنية|تكنولوجيا|تكنلوجيا|اقتصاد|اقتصادية|أعمال|سياسة|رياضة|فن|ثقافة|منوعات|عالم|"
    "دولي|محليات|محلي|صحة|علوم|سفر|سياحة|ألعاب|تعليم|حوادث|ميديا|فيديو|صور|بث مباشر|مباشر|عاجل|حصري|رأي|مقالات|"
    "تحقيقات|البطولات|بطولات|العالم|أسود|الدوري|كأس|main|home|homepage|index|news|markets|business|tech|technology|"
    "world|sports|health|science|culture|entertainment|features|opinion|analysis|review|reviews|lifestyle|travel|"
    "fashion|food|cars|automobile|property|real estate|futures|commodities|stocks|shares|finance|economy"
)
ROUNDUPS = phrases(
    "حصاد عام|حصاد السنة|مراجعة عام|ملخص عام|أهم الأخبار|أبرز الأحداث|year in review|year roundup|roundup|best of|"
    "top stories|award winners|awards"
)
TUTORIALS = phrases(
    "دورة|دورات|كورس|كورسات|درس|دروس|تدريب|تدريبات|تعليم|كيفية|طريقة|خطوات|دليل|إرشادات|شرح|شرحات|تدريب عملي|ورشة|"
    "ورشات|إعداد|إنشاء|برمجة|تصميم|tutorial|tutorials|course|courses|lesson|lessons|training|how to|how-to|guide|"
    "guides|manual|walkthrough|step by step|learn|learn css|learn html|learn javascript|studiostyle|css studio|"
    "html studio|import|export design"
)
AD_URL_PARTS = phrases(
    "livejournal.com|t.co|bit.ly|ad.|advert|banner|sponsor|promotion|shop.|store.|buy now|اشترِ|تسوق"
)
SECTION_TITLE_PARTS = phrases(
    "التصنيف:|التصنيف :|التواصل الاجتماعي|الأكثر قراءة|مقالات ذات صلة|التعليقات|الاسم|البريد الإلكتروني|"
    "الموقع الإلكتروني|ترك تعليق|إرسال تعليق|أضف تعليق|شارك المقال|شارك على|تابعنا على|حقوق النشر|جميع الحقوق|"
    "طباعة البريد|الالكتروني|اشترك في|للمزيد من الأخبار|latest news|breaking news|top news|all news|all articles"
)
INVALID_ARTICLE_PARTS = phrases(
    "أخبار قطاع الأعمال|أخبار القطاع|أخبار الشركات|أخبار التقنية|أخبار الرياضة|أخبار السياسة|أخبار الاقتصاد|"
    "أخبار المجتمع|أخبار المحلية|أخبار العالمية|أخبار الثقافة|أخبار الصحة|أخبار التعليم|أخبار العلوم|أخبار البيئة|"
    "أخبار السياحة|أخبار الترفيه|أخبار المنوعات|أخبار عاجلة|latest news|breaking news|top news|all news|all articles|"
    "مقالات|أخبار|تقارير|مجلة|مجلات|صحف|صحافة|إعلام|منوعات|العام|الكل|كل الأخبار"
)
PARAGRAPH_NOISE = (
    r"^(share|tweet|like|follow|subscribe|copy link|رابط|شارك|تغريد|تابع)\b",
    r"^.{1,60}[›|→»«]\s*$",
    r"(cookie|gdpr|privacy policy|كوكيز|سياسة الخصوصية)",
    r"https?://\S+\s*$",
    r"^(tags?|الوسوم|keywords?)\s*:",
    r"(©|\bcopyright\b|جميع الحقوق محفوظة)",
    r"^\d+\s*/\s*\d+\s*$",
    r"^(اقرأ أيض|read (also|more)|voir aussi)",
    r"(إعلان|sponsored|advertisement|publicité)",
    r"^[\d\s\W]{0,25}$",
    r"(كيفية|دورة|كورس|دروس|خطوات|دليل|تعليم|تدريب|شرح|إنشاء|إعداد)",
    r"(tutorial|how to|step by step|lesson|course|training|learn css|learn html|guide)",
)
QUALITY_BLOCKED = phrases(
    "privacy policy|terms of use|terms and conditions|cookie policy|login|sign in|register|subscribe|advertisement|"
    "sponsored|شروط الاستخدام|سياسة الخصوصية|سياسة الاستخدام|تسجيل الدخول|اشترك|إعلان|إعلانات|ملفات تعريف الارتباط"
)
GATE_SECTIONS = phrases(
    "الأخبار|أخبار|تقنية|تكنولوجيا|اقتصاد|اقتصادية|أعمال|سياسة|رياضة|فن|ثقافة|منوعات|عالم|دولي|محليات|محلي|صحة|علوم|"
    "سفر|سياحة|ألعاب|تعليم|حوادث|ميديا|فيديو|صور|بث مباشر|مباشر|عاجل|حصري|رأي|مقالات|تحقيقات|البطولات|بطولات|الدوري|"
    "كأس|news|markets|business|tech|technology|world|sports|health|science|culture|entertainment|features|opinion|"
    "analysis|review|reviews|lifestyle|travel|fashion|food|cars|automobile|property|real estate|futures|commodities|"
    "stocks|shares|finance|economy|home|homepage|index|main"
)
GATE_TUTORIALS = phrases(
    "دورة|دورات|كورس|كورسات|درس|دروس|تدريب|تدريبات|تعليم|كيفية|طريقة|خطوات|دليل|إرشادات|شرح|شرحات|tutorial|tutorials|"
    "course|courses|lesson|lessons|training|how to|how-to|guide|guides|manual|walkthrough|step by step|learn"
)
GATE_URL_PARTS = phrases(
    "/category/|/categories/|/tag/|/tags/|/author/|/authors/|/search|/archive|/archives|/home|/index|/page/|/live|"
    "/video|/videos|/gallery|/photos|/opinion|/opinions|/section|/sections|/topic/|/topics/"
)

# --- events -------------------------------------------------------------------------

EVENT_WORDS = phrases(
    "announced|declared|launched|signed|agreed|decided|elected|appointed|resigned|died|killed|injured|attacked|"
    "arrested|charged|convicted|sentenced|approved|rejected|passed|vetoed|ratified|won|lost|defeated|beat|scored|"
    "qualified|crashed|exploded|burned|flooded|earthquake|protested|demonstrated|striked|boycotted|invested|acquired|"
    "merged|split|laid off|a annoncé|a déclaré|a lancé|a signé|a décidé|أعلن|أعلنت|أطلق|وقع|اتفق|قرر|عين|استقال|توفي|"
    "قُتل|أصيب|هاجم|اعتقل|أُحيلا|أُدين|حكم|أُقر|أُرفض|فاز|خسر|انهزم|انهزمت|سجل|تأهل|انفجر|احترق|غرق|زلزل|تظاهر|اعتصم|"
    "أضرب|قاطع|استثمر|اشترى|اندمج|انفصل|أقال|moindre|dévoilé|présenté|lancé"
)
ACTION_VERBS = phrases(
    "announced|declared|launched|signed|agreed|decided|elected|appointed|resigned|approved|rejected|passed|vetoed|"
    "ratified|won|lost|defeated|crashed|exploded|burned|flooded|protested|invested|acquired|merged|struck|hit"
)
EVENT_TYPES = {
    "Conflict": "war|conflict|attack|bomb|shooting|حرب|صراع|هجوم|قنبلة|إطلاق نار|قصف|تدمير",
    "Political": "election|vote|campaign|انتخابات|تصويت|حملة|اقتراع|ناخب",
    "Sports": "match|game|tournament|مباراة|لعبة|بطولة|دوري|كأس|فريقين",
    "Entertainment": "concert|festival|show|حفل|مهرجان|عرض|فيلم|سينما",
}
SUBCATEGORIES = {
    "football": "football|soccer|كرة القدم|foot",
    "basketball": "basketball|كرة السلة|basket",
    "tennis": "tennis|تنس",
    "cricket": "cricket|كريكيت",
    "volleyball": "volleyball|كرة الطائرة",
    "handball": "handball|كرة اليد",
    "swimming": "swimming|سباحة|natation",
    "athletics": "athletics|ألعاب قوى|athletisme",
    "ai": "ai|artificial intelligence|ذكاء اصطناعي|intelligence artificielle",
    "crypto": "crypto|bitcoin|blockchain|عملات رقمية|crypto-monnaie",
    "mobile": "mobile|phone|هاتف|smartphone|téléphone",
    "cybersecurity": "cyber|security|امن معلومات|cybersécurité",
    "cloud": "cloud|سحابة|informatique en nuage",
    "quantum": "quantum|كمومي|quantique",
    "stocks": "stock|bourse|سوق الأسهم|marché boursier",
    "banking": "bank|بنك|banque",
    "startups": "startup|شركة ناشئة",
    "pandemic": "covid|كورونا",
    "oncology": "cancer|سرطان",
    "mental_health": "mental|نفسي|santé mentale",
}
# One entry per category; a deployment passes its own wider vocabulary instead.
CATEGORY_TERMS = {
    "politics": "president|minister|government|election|parliament|congress|senate|law|bill|policy|diplomat|embassy|"
                "summit|treaty",
    "economy": "economy|economic|market|stock|trade|business|company|investment|inflation|gdp|budget|tax|tariff",
    "sport": "sport|sports|football|soccer|basketball|tennis|match|game|team|player|coach|championship|tournament|"
             "league|goal|score",
    "tech": "technology|tech|software|hardware|computer|internet|website|app|application|digital|data|ai|"
            "artificial intelligence|robot|crypto",
    "science": "science|scientific|research|study|discovery|experiment|scientist|university|laboratory",
    "health": "health|healthcare|medical|medicine|hospital|doctor|patient|disease|virus|vaccine|treatment|therapy|clinic",
    "world": "world|international|global|foreign|overseas|dubai|london|paris|cairo|beirut|baghdad",
    "culture": "culture|cultural|art|artist|museum|gallery|exhibition|festival|concert|theater|theatre|film|movie|"
               "cinema|music|book|literature",
    "islamic": "islamic|islam|mosque|prayer|ramadan|hajj|umrah|quran|hadith|imam|sheikh",
    "women": "women|woman|female|girl|gender|feminist",
    "society": "society|social|community|people|citizen|crime|police|court|judge|lawyer",
}
CATEGORY_POINTS = {"sport": 3, "politics": 3, "tech": 3}
CATEGORY_IMPORTANCE = {
    "politics": 0.25, "economy": 0.20, "world": 0.20, "health": 0.20, "science": 0.15, "sport": 0.10, "culture": 0.10,
    "tech": 0.15,
}

# --- blending -----------------------------------------------------------------------

TITLE_CLICKBAIT = phrases(
    "شاهد بالفيديو|بالفيديو|لن تصدق|صدمة|فضيحة|عاجل جدا|مثير للجدل|خطير جدا|كارثة|شاهد ما حدث"
)
SENTENCE_BOILERPLATE = phrases(
    "تابعونا على|اشترك في قناتنا|حقوق النشر محفوظة|إقرأ أيضاً|المصدر:|جميع الحقوق محفوظة|اضغط هنا|شارك المقال|"
    "للمزيد من الأخبار|تطبيق هسبريس|تابعنا عبر فيسبوك|تابعنا على|انشر على|أخبار ذات صلة|مقالات مرتبطة|شاهد أيضاً|"
    "التعليقات|أضف تعليق|إرسال تعليق|جميع الحقوق|©|كل الحقوق"
)
BLEND_STOP = words(
    "في من إلى على هذا هذه أن كان كانت ليس لكن أو ثم أي كل مع عند بعد قبل حتى أيضا حيث التي الذي الذين اللتين اللاتي "
    "ذلك هو هي هم هن نحن أنت أنا قد ما لا إن عبر بين حول ضمن فوق تحت خلال"
)


def read_lexicon(spark: SparkSession, path: str, limit: int = 20000) -> dict[str, str]:
    """A ``(category, term)`` table as a vocabulary, refused when it is too large to ship with a plan."""
    rows = (
        spark.read.parquet(path).groupBy("category").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        .limit(limit + 1).collect()
    )
    if sum(len(r.terms) for r in rows) > limit:
        raise ValueError(f"lexicon holds more than {limit} terms")
    return {r.category: "|".join(r.terms) for r in rows}
