"""Dictionaries, thresholds and patterns as data. All of them are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- thresholds -------------------------------------------------------------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
HIGH, MEDIUM, FALLBACK = 0.25, 0.12, 0.20
PROMOTE_HIGH, PROMOTE_MEDIUM = 0.4, 0.6
WEIGHT_V, WEIGHT_AUTH, WEIGHT_RETRIEVAL = 0.50, 0.30, 0.20
SEVERITY_WEIGHT = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5}
CONFLICT_PENALTY = {"critical": 0.08, "high": 0.05, "medium": 0.03, "low": 0.01}
PENALTY_CLIP, FLOOR_CONFIRMED = 0.85, 0.05
ARITHMETIC_PENALTY, ARTICLE_BOOST, VIRTUAL_COEFFICIENT = 0.5, 0.35, 0.5
FUSION_WEIGHTS = (0.55, 0.30, 0.15)
COSINE_DUPLICATE, HIERARCHY_DELTA, YEAR_GAP = 0.92, 2, 2
GAP_JACCARD, CHRONOLOGY_DISTANCE = 0.6, 500

# --- ranks and tiers --------------------------------------------------------------------------------------------------
#: Lower is stronger; a code outranks a constitutional law.
LEGAL_RANKS = {
    "CONSTITUTION": 1, "CODE": 2, "CONSTITUTIONAL_LAW": 3, "LAW_RK": 4, "DECREE": 5, "GOV_RESOLUTION": 6,
    "MINISTERIAL_ORDER": 7, "LOCAL_ACT": 8, "COURT_PRACTICE": 9, "EXPERT": 10, "OTHER": 11,
}
#: SCA-22, fixed lists.
TIER_1 = (
    "gov.kz", "adilet.zan.kz", "supreme.kz", "primeminister.kz", "president.kz", "parliament.kz", "minjust.gov.kz", "kkm.gov.kz", "minfin.gov.kz", "mfa.gov.kz",
    "stat.gov.kz",
)
TIER_2 = ("zakon.kz", "tengrinews.kz", "forbes.kz", "profit.kz", "vlast.kz", "kapital.kz", "kursiv.kz", "inform.kz", "kazpravda.kz", "legalacts.kz")
TIER_3 = (
    "linkedin.com", "vc.ru", "medium.com", "habr.com", "dtf.ru", "tjournal.ru", "wikipedia.org", "ru.wikipedia.org", "en.wikipedia.org", "kk.wikipedia.org",
    "wikiwand.com", "pravo163.ru", "consultant.ru", "garant.ru",
)
BLACKLIST = ("forum", "otvet.mail.ru", "reddit.com", "anon", "pikabu.ru", "answers.yahoo.com", "mail.ru/community")
SPAM_URLS = ("egov.kz/cms", "egov.kz/news", "egov.kz/mobile", "/press/news/", "/press/article/", "/memleket/entities/", "akimat.", "oq.gov.kz", "cert.gov.kz/news", "pki.gov.kz", "eresidency.gov.kz")
TRUSTED_URLS = ("adilet.zan.kz", "online.zakon.kz", "prokuror.gov.kz", "supreme.kz", "parlam.kz", "tengrinews.kz/zakon", "informburo.kz", "zakon.kz")
SPAM_CONTENT = r"(?iu)eGov\s*Mobile|скачать\s*приложени|пошаговая\s*инструкц|войти\s*через|QR.?код|биометрическ.*идентификаци.*как|пресс.?релиз|новости\s*министерств|ЦОН\s*находится|государственная\s*корпорация.*граждан|удостоверение\s*личности.*заменить|eGov.*результат"
LEGAL_SIGNAL = (
    r"(?iuU)стать[яиью]\s*\d+|№\s*\d+.{1,5}[IVXLC]+|Кодекс\s*РК|Закон\s*РК|УК\s*РК|КоАП\s*РК|МРП|месячн\w+\s*расчетн|штраф|санкци|ответственност"
    r"|пункт\s*\d+|часть\s*\d+|персональн\w+\s*данн|субъект\w*\s*данн|оператор\w*\s*данн|уведомлени|обработк\w+\s*данн|законопроект|нормативн|регулирован"
    r"|согласи\w+\s*субъект|трансграничн|локализаци\w+\s*данн|локализаци\w+\s*сервер|уполномоченн\w+\s*орган|кибербезопасност|информационн\w+\s*безопасн"
    r"|защит\w+\s*данн|конфиденциальн|биометрическ|идентификаци|дактилоскоп|цифров\w+\s*Казахстан|электронн\w+\s*правительств|административн\w+\s*правонарушен|уголовн\w+\s*ответственност"
)
GAP_MARKERS = (
    "на практике", "фактически", "не исполняется", "игнорируется", "не применяется", "обходят", "коррупция", "не работает", "де-факто", "де факто",
    "в реальности", "нарушается", "не соблюдается", "слабо исполняется", "де юре", "de facto", "in practice", "not enforced", "rarely applied",
    "compliance gap", "unenforced", "loophole", "workaround", "circumvented", "paper law", "іс жүзінде", "орындалмайды", "сақталмайды", "бұзылады",
)
HIERARCHY_SIGNALS = ("коап", "иерарх", "подзакон", "ппрк", "постановление правительства", "приказ министр", "legal_rank")
TEMPORAL_SIGNALS = ("срок", "дата", "дней", "часов", "месяц", "вступает", "действие", "времен")

# --- tokeniser word lists ---------------------------------------------------------------------------------------------
#: SCA-06, SCA-16: stop words, fixed.
STOP_WORDS = (
    "и", "в", "на", "с", "по", "от", "до", "за", "при", "о", "об", "из", "или", "а", "но", "что", "как", "это", "не", "к", "для", "то", "же", "бы",
    "ли", "со", "да", "уж", "ведь", "вот", "ну", "ж", "the", "a", "an", "of", "in", "is", "are", "was", "were", "және", "жəне", "немесе", "бойынша",
    "туралы", "бірақ", "алайда", "сондай-ақ", "сонымен", "яғни", "мен", "үшін", "арқылы", "дейін", "кейін", "бұл", "сол", "осы", "ол", "оның", "оған",
    "олар", "олардың", "bar", "жоқ", "болып", "болады", "болса", "болған", "керек", "тиіс", "деп", "деген", "мынадай", "қарай", "қарсы", "ретінде",
    "тиісінше", "жағдайда", "сәйкес", "белгіленген", "көзделген", "айқындалған", "тәртіппен", "негізінде", "орай", "республикасы", "қазақстан",
    "қолданысқа", "енгізіледі", "жарияланған", "настоящий", "вводится", "действие", "истечении", "официального", "опубликования", "республика",
    "казахстан", "внести", "изменения", "дополнения", "некоторые", "законодательные", "акты", "вопросам",
)
#: SCA-07: stop words of legal texts, fixed.
LEGAL_STOP_WORDS = (
    "закон", "кодекс", "статья", "статье", "статьи", "республики", "казахстан", "утратил", "силу", "вводится", "действие", "постановление",
    "правительства", "республика", "закона", "кодекса", "об", "о", "и", "в", "на", "для", "рк", "заң", "кодексі", "бап", "баптың", "туралы", "және",
    "қазақстан", "республикасы", "заңы", "үкіметі", "заңда", "үшін", "жәнінде", "болады", "емес", "немесе", "қорған", "рәсімі",
)
#: SCA-07: suffixes in the order in which they are tried, fixed.
SUFFIXES = (
    "ями", "ами", "ому", "ему", "ого", "его", "ыми", "ими", "ых", "их", "ею", "ою", "ом", "ем", "ой", "ей", "ию", "ую", "яя", "ая", "ое", "ее", "ые",
    "ие", "ия", "ый", "ий", "ам", "ям", "ов", "ев", "ях", "ах", "а", "я", "о", "е", "и", "ы", "у", "ю", "ь", "ға", "ге", "ғе", "да", "де", "на", "ні",
    "ның", "нің", "ды", "ді", "ты", "ті", "лар", "лер", "дар", "дер", "мен", "сен", "оны", "оні", "біз", "сіз", "ған", "ген", "ке", "қа", "ші", "шы",
)
DIGRAPHS = {"Gh": "Ғ", "Zh": "Ж", "Sh": "Ш", "Ch": "Ч", "Kh": "Қ", "gh": "ғ", "zh": "ж", "sh": "ш", "ch": "ч", "kh": "қ"}
#: SCA-01: letters with marks and what they stand for, fixed.
DIACRITICS = {"á": "ә", "Á": "Ә", "ı": "і", "I": "І", "ñ": "ң", "Ñ": "Ң", "ó": "ө", "Ó": "Ө", "ú": "ү", "Ú": "Ү"}
#: SCA-02: letters and words of Kazakh in Latin script, fixed.
KAZAKH_LATIN_LETTERS = "áñóúığşý"
KAZAKH_LATIN_WORDS = ("jane", "jáne", "bolady", "qazaqstan", "turaly", "týraly", "kodeksi", "zań", "zang", "memleket", "respyblıkasy", "respublika")
KAZAKH_LETTERS = "әғқңөұүһіӘҒҚҢӨҰҮҺІ"

# --- reference data ---------------------------------------------------------------------------------------------------
MRP_BY_YEAR = {2019: 2525, 2020: 2651, 2021: 2917, 2022: 3063, 2023: 3450, 2024: 3692, 2025: 3932, 2026: 4205}
MZP_BY_YEAR = {2022: 60_000, 2023: 70_000, 2024: 85_000, 2025: 100_000}
MAX_FINE_MRP = 2000
#: VRD-01: ids and decrees that are known not to exist.
INVALID_LAWS, INVALID_DECREES = ("87-IV",), ("142",)
#: SCA-20: the offence code, whose short title lacks the word code.
OFFENCE_CODE = "235-V"
LAW_ALIASES = {"233-IV": "261-IV", "309-II": "409-I", "95-IV": "171-VIII", "212-IV": "400-VI-NEW"}
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}


def table(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    """A fixed dictionary as a small table; its size doesn't depend on any input."""
    return spark.createDataFrame(list(values.items()), [key, value])

# --- law names (fixed values) -----------------------------------------------------------------------------------------
#: SCA-13: names and abbreviations of laws and the ids they stand for; names of up to 3 characters count as whole words.
LAW_NAMES = {
    "гк": ("1000-XIII", "309-II"),
    "гкрк": ("1000-XIII", "309-II"),
    "гражданск": ("1000-XIII", "309-II"),
    "азаматтық кодекс": ("1000-XIII", "309-II"),
    "ак": ("1000-XIII", "309-II"),
    "акрк": ("1000-XIII", "309-II"),
    "зк": ("442-II",),
    "зкрк": ("442-II",),
    "земельн": ("442-II",),
    "жк": ("442-II",),
    "жкрк": ("442-II",),
    "жер кодекс": ("442-II",),
    "коап": ("235-V",),
    "коапрк": ("235-V",),
    "әқбтк": ("235-V",),
    "әқбткрк": ("235-V",),
    "әкімшілік құқық бұзушылық": ("235-V",),
    "ук": ("226-V",),
    "укрк": ("226-V",),
    "уголовн": ("226-V",),
    "ққ": ("226-V",),
    "ққрк": ("226-V",),
    "қылмыстық кодекс": ("226-V",),
    "аппк": ("350-VI",),
    "госимуществ": ("413-IV",),
    "государственному имуществу": ("413-IV",),
    "государственного имущества": ("413-IV",),
    "налогов": ("214-VII",),
    "нк": ("214-VII",),
    "бюджетн": ("171-VIII",),
    "бк": ("171-VIII",),
    "трудов": ("414-I-NEW",),
    "тк": ("414-I-NEW",),
    "экологическ": ("400-VI-NEW",),
    "эк": ("400-VI-NEW",),
    "электронном документе": ("370-II",),
    "эцп": ("370-II",),
    "информатизации": ("418-V",),
    "искусственном интеллекте": ("230-VIII",),
    "цифровой кодекс": ("255-VIII",),
    "цифрового кодекса": ("255-VIII",),
    "исполнительном производстве": ("261-IV",),
    "исполнительного производства": ("261-IV",),
    "судебных исполнителей": ("261-IV",),
    "сот орындаушы": ("261-IV",),
    "атқарушылық іс жүргізу": ("261-IV",),
    "233-IV": ("261-IV",),
}
#: SCA-14: phrases of law titles in a bill's heading and the id they tell.
TITLE_HINTS = {
    "исполнительном производстве": "261-IV",
    "судебных исполнителей": "261-IV",
    "атқарушылық іс жүргізу": "261-IV",
    "сот орындаушылар": "261-IV",
    "персональных данных": "94-V",
    "дербес деректер": "94-V",
    "административных правонарушениях": "235-V",
    "әкімшілік құқық бұзушылық": "235-V",
    "уголовный кодекс": "226-V-UK",
    "қылмыстық кодекс": "226-V-UK",
    "гражданский кодекс": "1000-XIII",
    "азаматтық кодекс": "1000-XIII",
    "земельный кодекс": "442-II",
    "жер кодекс": "442-II",
    "трудовой кодекс": "414-I-NEW",
    "еңбек кодекс": "414-I-NEW",
    "налоговый кодекс": "214-VII",
    "салық кодекс": "214-VII",
    "об образовании": "319-III",
    "білім туралы": "319-III",
    "о государственных закупках": "106-VIII",
    "мемлекеттік сатып алу": "106-VIII",
    "о противодействии коррупции": "410-V-NEW",
    "сыбайлас жемқорлыққа қарсы": "410-V-NEW",
    "об информатизации": "418-V",
    "информатизация туралы": "418-V",
    "о связи": "567-II-NEW",
    "байланыс туралы": "567-II-NEW",
    "о банках": "258-VIII",
    "банктер туралы": "258-VIII",
    "об исполнительных документах": "261-IV",
    "о нотариате": "155-I",
    "нотариат туралы": "155-I",
}

# --- reference tables (fixed values) ----------------------------------------------------------------------------------
#: SCA-38: year to the law that set its index.
MRP_SOURCES = {
    2025: "Закон РК от 29.11.2024 № 133-VIII «О республиканском бюджете на 2025-2027 годы»",
    2024: "Закон РК от 01.12.2023 № 44-VIII «О республиканском бюджете на 2024-2026 годы»",
    2023: "Закон РК от 01.12.2022 № 174-VII «О республиканском бюджете на 2023-2025 годы»",
}
#: SCA-38: id to title, date and whether the law exists.
KNOWN_LAWS = {
    "94-V": ("О персональных данных и их защите", "2013-05-21", True),
    "87-IV": ("ВНИМАНИЕ: номер 87-IV НЕ существует для Закона о ПД. Правильный: 94-V", None, False),
    "235-V": ("Кодекс РК об административных правонарушениях (КоАП)", "2014-07-05", True),
    "226-V": ("Уголовный кодекс Республики Казахстан (УК РК)", "2014-07-03", True),
    "231-V": ("Уголовно-процессуальный кодекс РК", "2014-07-04", True),
    "350-VI": ("Административный процедурно-процессуальный кодекс (АППК)", "2020-07-29", True),
    "255-VIII": ("Цифровой кодекс Республики Казахстан", "2026-01-09", True),
    "261-IV": ("Об исполнительном производстве и статусе судебных исполнителей", "2010-04-02", True),
    "418-V": ("Об информатизации", "2015-11-24", True),
    "370_": ("Об электронном документе и электронной цифровой подписи", "2003-01-07", True),
    "199-V": ("Об органах внутренних дел", "2014-11-23", True),
    "401-V": ("О доступе к информации", "2015-11-16", True),
    "230-VIII": ("Об искусственном интеллекте", "2025-07-01", True),
    "256-VIII": ("О внесении изменений в законодательство в связи с принятием Цифрового кодекса", "2026-01-09", True),
    "133-VIII": ("О республиканском бюджете на 2025-2027 годы", "2024-11-29", True),
    "ППРК-909": ("Об утверждении Правил осуществления мер по защите ПД", "2013-11-12", True),
    "ППРК-1214": ("Об утверждении Правил определения перечня ПД", "2013-11-12", True),
    "ППРК-142": ("НЕ СУЩЕСТВУЕТ: ППРК №142 не найдено в реестре НПА о персональных данных", None, False),
    "ППРК-374": ("Об определении оператора «цифрового правительства»", "2026-02-10", True),
}
#: SCA-38: article of the offence code to title, most for persons and for entities in MRP, notes.
OFFENCES = {
    "79": ("Нарушение законодательства о персональных данных и их защите", 200, 2000, "Основная статья за нарушения закона о ПД. Штраф 200 МРП для физлиц, до 2000 МРП для юрлиц."),
    "640": ("Нарушение законодательства об электронном документе и ЭЦП", 100, 1000, "Статья применяется к нарушениям при использовании ЭЦП."),
    "641": ("Нарушение требований в области информационной безопасности", 200, 2000, "Применяется к нарушениям требований ИБ."),
}
MOST_FINES = {"физлица": 200, "должностные": 500, "юрлица_мсб": 200, "юрлица": 2000, "absolute_max": 2000}
#: SCA-38: article of the criminal code to title and notes.
CRIMES = {
    "147": ("Нарушение неприкосновенности частной жизни и законодательства Республики Казахстан о персональных данных и их защите", "Незаконный сбор и распространение персональных данных. Уголовная ответственность."),
    "205": ("Неправомерный доступ к информации", "Глава 7 УК («Уголовные правонарушения в сфере информатизации и связи»). Релевантна биллям о ПД/информбезопасности."),
    "206": ("Неправомерные уничтожение или модификация информации", "Глава 7 УК. Релевантна биллям о ПД/информбезопасности."),
    "207": ("Нарушение работы объекта информатизации", "Глава 7 УК. Релевантна биллям о ПД/информбезопасности."),
    "208": ("Неправомерное завладение информацией", "Глава 7 УК. Релевантна биллям о ПД/информбезопасности."),
    "215": ("Лжепредпринимательство", "НЕ СВЯЗАНА с персональными данными."),
}
BREACH_NOTICE = "Закон РК 94-V «О персональных данных» не устанавливает срок уведомления об утечке в часах. Приказ от 2026-07-12 (V2600038665) вводит механизм уведомления, но срок в нём — не 24 часа."
THIRD_PARTY_DAYS = 10
#: SCA-23: words of a page and the law they stand for, in order.
PAGE_HINTS = (
    (("гражданск", " гк"), "1000-XIII"),
    (("уголовн", " ук", " қк"), "226-V-UK"),
    (("коап", "административн", "әкімшілік құқық бұзушылық"), "235-V"),
    (("трудов", "еңбек кодекс"), "414-I-NEW"),
    (("земельн", "жер кодекс"), "442-II"),
    (("налогов", "салық кодекс"), "214-VII"),
    (("исполнительном производстве", "судебных исполнителей", "атқарушылық іс жүргізу"), "261-IV"),
)
