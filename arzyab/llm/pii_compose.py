"""Composed spans of personal information for training and for independent scoring.

Items are put together from parts (names, ways, digits, separators) in many written forms, wrapped in carrier phrases, and inserted
between the sentences of real descriptions together with look-alikes that are no items. The last quarter of every list is held out of
training, so that scoring meets names and carriers that training never did.
"""

from __future__ import annotations

import numpy as np

from arzyab.llm.pii import TYPES

# Common given and family names, ways, words of numbers, and carriers, in folded spelling.
GIVEN_FA = "علی محمد حسین رضا مهدی امیر حسن عباس سعید حمید مجید وحید ناصر بهرام بهمن فرهاد کامران پیمان ارش سهراب اردشیر کیوان نیما سینا پویا میلاد یاسر هادی جواد مرتضی مصطفی داود یوسف ابراهیم اسماعیل موسی عیسی صادق باقر کاظم تقی زهرا فاطمه مریم سارا نرگس لیلا شیرین مینا نسرین پروین مهین زینب سمیه الهام ندا نگار نازنین پریسا مهسا شیما هانیه رویا فرزانه افسانه شهلا مژگان بهناز طاهره معصومه خدیجه ایدا شبنم سپیده الناز محمدرضا علیرضا امیرحسین محمدعلی غلامرضا عبدالله حسینعلی رحمان کریم رحیم جعفر قاسم شهاب سیاوش کاوه بابک خسرو منوچهر هوشنگ جمشید داریوش ایرج تورج فریدون مازیار شاهین شهرام شهریار بیژن فرشید فرزاد مسعود محسن مهران بهزاد بهروز پرویز جلال جمال کمال حامد حبیب خلیل سلمان طاها عرفان پدرام پارسا ارمین ارمان رامین رامتین سامان سپهر اشکان فاطیما زهره مرضیه راضیه صدیقه سکینه اعظم اکرم اشرف پروانه ترانه بهاره سمانه ریحانه حدیث مهناز فرناز گلناز سوسن لاله نیلوفر یاسمن هستی کیمیا مبینا ستایش فریبا فریده فرشته نسترن سودابه سیمین مهری منیژه رعنا راحله".split()
FAMILY_FA = "محمدی حسینی احمدی کریمی رضایی موسوی هاشمی جعفری صادقی رحیمی قاسمی ابراهیمی اکبری نوری مرادی حیدری یوسفی سلطانی رستمی شریفی باقری کاظمی عباسی نجفی امینی طاهری فتحی زارعی عزیزی بهرامی کمالی شجاعی فرهادی صالحی ملکی یزدانی شیرازی تهرانی اصفهانی تبریزی خراسانی رفیعی قربانی اسدی نظری حسنی علوی میرزایی خسروی جمشیدی کاویانی سهرابی پهلوان دهقان صباغ نجار کشاورز بنایی درویش شهبازی نیکو راد فروغی توکلی پناهی سعیدی وحیدی مظفری معتمد معینی اشرفی افشار قنبری لطفی مقدم یگانه بیات خلیلی جلیلی کمالوند میرزا میرزاخانی خانی بختیاری لرستانی گیلانی مازندرانی همدانی کاشانی قمی یزدی کرمانی زنجانی اردبیلی قزوینی سمنانی بوشهری دزفولی بهشتی مطهری منتظری طالقانی خاتمی روحانی لاریجانی قالیباف زمانی عظیمی سلیمانی داودی حاتمی رحمانی رسولی ربانی شکوری شاکری صبوری صمدی عباسپور عبدی غلامی فاضلی فلاح کبیری گودرزی محبی محسنی مصطفوی مقدسی ناصری نصیری نعمتی هدایتی همتی ولی پاکزاد پارسا پیروز ترکمان حجازی حقیقی خدایی خوشدل دانش ذاکری رنجبر زمردی سالاری".split()
GIVEN_EN = "john sara david maria peter anna james linda robert susan michael karen thomas nancy daniel laura ali reza maryam hassan omar leila nina tom kate emma oliver jack lucy george helen mark julia paul diana simon grace victor irene martin alice henry clara".split()
FAMILY_EN = "smith johnson brown taylor miller davis wilson moore anderson jackson white harris martin clark lewis walker hall young king wright hill green baker adams nelson carter ahmadi karimi hosseini rezaei mohammadi moradi rahimi petrov ivanov schmidt weber fischer rossi silva garcia lopez".split()
SUFFIX_FA = "زاده پور نژاد نیا فر خواه منش یان لو وند چی دوست پناه".split()
SYLLABLES = "را سا تا نا مه دی ران شا کا لان وا پا گل زی نو تیر دار سان رو هی فام بل جین وند ویر سر ما با خا".split()
SYLLABLES_EN = "ra sa ta na me di ran sha ka lan va pa gol zi no tir dar san ru hi fam bel jin vand sar li to qu hen".split()
TITLES_FA = "اقای خانم جناب جناب اقای سرکار خانم مهندس دکتر استاد حاج اقا حاج خانم سید".replace("جناب اقای", "جناب_اقای").replace("سرکار خانم", "سرکار_خانم").replace("حاج اقا", "حاج_اقا").replace("حاج خانم", "حاج_خانم").split()
TITLES_EN = "mr mrs ms dr miss mr. mrs. ms. dr. eng.".split()
WAYS_FA = "خیابان خ خ. بلوار کوچه ک کوی میدان بنبست بزرگراه جاده گذر فلکه چهارراه خیابان فرعی".replace("خیابان فرعی", "خیابان_فرعی").split()
NUMBER_FA = "پلاک پلاک پلاک پ پ. شماره شماره ش پلاک: شماره:".split()
UNIT_FA = "واحد طبقه ط ط. زنگ و.".split()
WAYS_EN = "street st st. avenue ave ave. road rd alley lane boulevard blvd square drive".split()
HOSTS = "example.com mail.ir yahoo.com gmail.com example.net chmail.ir melk.example host-iran.org outlook.com inbox.example my-home.co.ir".split()
BEFORE_NAME = ["مالک: ", "مالک ", "هماهنگی با ", "تماس با ", "کلید نزد ", "فروشنده: ", "فروشنده ", "نماینده فروش ", "با ", "لطفا با ", "", "بازدید با ", "سازنده ", "مسیول بازدید ", "نام مالک ", "صاحبخانه ", "از طرف ", "موجر: ", "کارشناس: "]
AFTER_NAME = ["", "", " تماس بگیرید", " پاسخگو هستند", " است", " هماهنگ شود", " سازنده بنا", " موجود است", " در خدمت است"]
BEFORE_NAME_EN = ["contact ", "contact: ", "ask for ", "owner ", "owner: ", "call ", "managed by ", "agent: ", "تماس: ", "speak to ", "key with ", "by "]
AFTER_NAME_EN = ["", "", " for a visit", " will show the flat", " any time", " after five"]
BEFORE_PHONE = ["", "تماس: ", "تلفن ", "تلفن: ", "همراه ", "واتساپ ", "شماره ", "لطفا با ", "call ", "tel: ", "فقط پیامک به ", "موبایل: ", "phone ", "whatsapp "]
AFTER_PHONE = ["", "", " تماس بگیرید", " پاسخگو هستم", " anytime", " زنگ بزنید"]
BEFORE_MAIL = ["", "ایمیل ", "ایمیل: ", "mail: ", "e-mail ", "نشانی الکترونیکی: ", "ارسال مدارک به ", "عکس بیشتر ", "write to ", "پست الکترونیک "]
BEFORE_ID = ["", "کد ملی ", "کدملی: ", "شماره ملی ", "احراز هویت با ", "id ", "national id: ", "شناسه ", "به کد ملی "]
BEFORE_PASS = ["گذرنامه ", "پاسپورت: ", "passport ", "passport no. ", "شماره گذرنامه ", "passport: ", "با پاسپورت "]
BEFORE_ADDRESS = ["", "ادرس: ", "نشانی ملک ", "محل بازدید ", "نشانی: ", "واقع در ", "ادرس دقیق ", "بازدید در "]
BEFORE_ADDRESS_EN = ["", "visit us at ", "address: ", "located at ", "ادرس: ", "come to "]
ENDS = [". ", " - ", "\n", " / ", ", ", "؛ ", " "]


def part(words: list[str], held: bool) -> list[str]:
    """The held-out last quarter of a list, or the rest."""
    cut = len(words) - len(words) // 4
    return words[cut:] if held else words[:cut]


class Composer:
    """Draws labelled phrases: each is a list of (text, type or None)."""

    def __init__(self, seed: int, held: bool = False, known_carriers: bool = False):
        self.rng, self.held, self.known_carriers = np.random.default_rng(seed), held, known_carriers

    def one(self, words: list[str], split: bool = True) -> str:
        carrier = any(w[-1:] in " :" for w in words)
        words = part(words, self.held and not (carrier and self.known_carriers)) if split else words
        return words[int(self.rng.integers(len(words)))].replace("_", " ")

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def made_up(self, english: bool = False) -> str:
        pick = SYLLABLES_EN if english else SYLLABLES
        return "".join(pick[i] for i in self.rng.integers(0, len(pick), int(self.rng.integers(2, 5))))

    def word(self) -> str:
        """Letters as words have them, in no list."""
        letters = "ابتجحخدرزسشصطعغفقکگلمنوهیپچ"
        return "".join(letters[i] + ("ا" if self.chance(0.25) else "") for i in self.rng.integers(0, len(letters), int(self.rng.integers(2, 5))))

    def given(self) -> str:
        return self.one(GIVEN_FA) if self.chance(0.5) else self.word() if self.chance(0.5) else self.made_up()

    def family(self) -> str:
        if self.chance(0.4):
            return self.one(FAMILY_FA)
        stem = self.one(GIVEN_FA) if self.chance(0.35) else self.word() if self.chance(0.6) else self.made_up()
        return stem + (self.one(SUFFIX_FA) if self.chance(0.5) else "ی" if self.chance(0.6) else "")

    def name(self) -> list:
        if self.chance(0.25):
            first = self.one(GIVEN_EN) if self.chance(0.5) else self.made_up(True)
            last = self.one(FAMILY_EN) if self.chance(0.5) else self.made_up(True)
            before = self.one(BEFORE_NAME_EN)
            if self.chance(0.06):
                return [(f"{self.one(GIVEN_EN)} {self.one(FAMILY_EN)}", "person_name")]
            if self.chance(0.4):
                return [(before + self.one(TITLES_EN) + " ", None), (last if self.chance(0.5) else f"{first} {last}", "person_name"), (self.one(AFTER_NAME_EN), None)]
            return [(before, None), (f"{first} {last}", "person_name"), (self.one(AFTER_NAME_EN), None)]
        if self.chance(0.55):
            title = self.one(TITLES_FA, split=False) + " "
            return [(self.one(BEFORE_NAME) + title, None), (self.family() if self.chance(0.5) else f"{self.given()} {self.family()}", "person_name"), (self.one(AFTER_NAME), None)]
        if self.chance(0.06):  # a name alone, which only known names can show
            return [(f"{self.one(GIVEN_FA)} {self.one(FAMILY_FA)}", "person_name")]
        before = self.one(BEFORE_NAME) or "مالک: "
        return [(before, None), (f"{self.given()} {self.family()}", "person_name"), (self.one(AFTER_NAME), None)]

    def phone(self) -> list:
        gap = ["", "", " ", "-", ".", " - ", "  ", ") "][int(self.rng.integers(8))]
        gap, opened = (" ", "(") if gap == ") " else (gap, "")
        if self.chance(0.75):
            tail = [self.digits(3), *([self.digits(3), self.digits(4)] if self.chance(0.7) else [self.digits(3), self.digits(2), self.digits(2)])]
            head = ["0", "+98", "0098", "+98 ", "0098 ", "98 ", "(+98) "][int(self.rng.choice(7, p=[0.55, 0.15, 0.08, 0.1, 0.04, 0.04, 0.04]))]
            tail[0] = "9" + tail[0][:2]
        else:
            head, tail = "0", [str(self.rng.integers(11, 88)), self.digits(4), self.digits(4)] if self.chance(0.6) else [self.digits(2), self.digits(8)]
        if opened and head == "0":
            text = f"(0{tail[0]})" + (" " if self.chance(0.6) else "") + gap.join(tail[1:])
        elif self.chance(0.15):
            text = head + (gap.join("".join(tail)) if gap and len(gap) == 1 else "".join(tail))
        else:
            text = head + gap.join(tail)
        return [(self.one(BEFORE_PHONE), None), (text, "phone"), (self.one(AFTER_PHONE), None)]

    def email(self) -> list:
        word = lambda: self.one(GIVEN_EN) if self.chance(0.4) else self.made_up(True)
        local = word() + (["", ".", "_", "-", "+"][int(self.rng.integers(5))] + (word() if self.chance(0.5) else self.digits(int(self.rng.integers(1, 5)))) if self.chance(0.7) else "")
        host = self.one(HOSTS) if self.chance(0.6) else f"{word()}.{['com', 'ir', 'net', 'org', 'example'][int(self.rng.integers(5))]}"
        at = ["@", "@", "@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " at "][int(self.rng.integers(11))]
        dot = "." if len(at) < 3 and self.chance(0.7) or self.chance(0.4) else ["[dot]", "(dot)", " dot ", " [dot] ", " . "][int(self.rng.integers(5))]
        if at == " at " and dot in (".", " . "):
            dot = " dot "
        before = self.one(BEFORE_MAIL)
        mail = local + at + host.replace(".", dot)
        return [(before + "<", None), (mail, "email"), (">", None)] if self.chance(0.1) else [(before, None), (mail, "email")]

    def identity(self) -> list:
        if self.chance(0.3):
            letter = "abcdefghijklmnopqrstuvwxyz"[int(self.rng.integers(26))]
            return [(self.one(BEFORE_PASS), None), (letter + (" " if self.chance(0.3) else "") + self.digits(int(self.rng.choice([7, 8, 8, 8, 9]))), "identity_number")]
        d = self.rng.integers(0, 10, 9)
        r = int((d * np.arange(10, 1, -1)).sum() % 11)
        code = "".join(map(str, d)) + str(r if r < 2 else 11 - r)
        gap = ["", "", "", "-", " "][int(self.rng.integers(5))]
        return [(self.one(BEFORE_ID), None), (gap.join([code[:3], code[3:9], code[9:]]), "identity_number")]

    def address(self) -> list:
        number = str(self.rng.integers(1, 400))
        if self.chance(0.25):
            name = (self.one(FAMILY_EN) if self.chance(0.3) else self.made_up(True)) + (" " + ["east", "west", "north", "new"][int(self.rng.integers(4))] if self.chance(0.2) else "")
            way = f"{name} {self.one(WAYS_EN, split=False)}"
            unit = ["", "", f", unit {self.digits(1)}", f" unit {self.digits(2)}", f", apt {self.digits(1)}"][int(self.rng.integers(5))]
            said = [f"no. {number}, {way}", f"no {number} {way}", f"{number} {way}", f"{number}, {way}", f"{way} no. {number}", f"{way}, number {number}", f"{way} {number}"][int(self.rng.integers(7))]
            return [(self.one(BEFORE_ADDRESS_EN), None), (said + unit, "street_address")]
        gap = [", ", ", ", " - ", " ", " ,", "؛ "][int(self.rng.integers(6))]
        short = self.chance(0.3)
        ways = []
        for _ in range(int(self.rng.integers(1, 4))):
            way = ["خ", "ک", "خ.", "ک.", "م", "ب"][int(self.rng.integers(6))] if short else self.one(WAYS_FA, split=False)
            name = self.one(FAMILY_FA) if self.chance(0.25) else self.made_up()
            if self.chance(0.15):
                name = ("شهید " if self.chance(0.6) else "") + (f"{self.one(GIVEN_FA)} " if self.chance(0.5) else "") + name
            if self.chance(0.25):
                name += " " + ["شرقی", "غربی", "شمالی", "جنوبی", "اول", "دوم", "سوم", str(self.rng.integers(1, 40))][int(self.rng.integers(8))]
            elif self.chance(0.1):
                name = str(self.rng.integers(1, 60))
            ways.append(f"{way} {name}")
        joined = (" " if short else gap).join(ways) if self.chance(0.85) else " نبش ".join(ways)
        word = ["پ", "پ.", "ش", "پلاک"][int(self.rng.integers(4))] if short else self.one(NUMBER_FA, split=False)
        unit = f"{' ' if short else [' ', ', '][int(self.rng.integers(2))]}{self.one(UNIT_FA, split=False)} {self.rng.integers(1, 30)}" if self.chance(0.45) else ""
        return [(self.one(BEFORE_ADDRESS), None), (f"{joined}{' ' if short else gap}{word} {number}{unit}", "street_address")]

    def look_alike(self) -> list:
        """A phrase that holds no item."""
        n, d = self.made_up(), self.digits
        person = f"{self.given()} {self.family()}"
        return [(self.one([
            f"کد اگهی {d(10)} را بفرمایید", f"شماره سند {d(1)}-{d(10)} صفحه {d(2)}", f"شماره پرونده ثبتی {d(10)} موجود است", f"file no {d(10)}", f"ad code {d(9)}", f"پلاک ثبتی {d(2)} فرعی از {d(3)} اصلی",
            f"تاریخ تحویل 14{d(2)}/{d(2)}/{d(2)}", f"ساعت {d(1)} تا {d(2)}:{d(2)}", f"هماهنگی با املاک {n}{self.one(SUFFIX_FA)}", f"مشاور املاک {person}", f"دفتر {self.family()} شعبه مرکزی", f"بنگاه {person} در خدمت شماست",
            f"نزدیک پارک {n}", f"برج {person} از معروفترین", f"در خیابان {person}", f"نزدیک میدان {n}", f"کوچه پهن {d(2)} متری", f"بر بلوار {n} {d(2)} متری", f"مجتمع مهندس {self.family()}", f"بیمارستان دکتر {self.family()}",
            "طبق نظر مهندس ناظر پروژه", "مناسب خانم یا اقای مجرد", "مناسب مطب دکتر", "با مالک محترم هماهنگ شود", "مناسب خانم دکتر و مهندس", "قیمت نهایی @ توافق حضوری", f"{d(3)} متر {n} و {d(2)} متر بالکن", f"قیمت {d(10)} تومان",
            f"price {d(9)} rials", "call for more details", "contact the agency", "owner will be present", "close to main street and park", f"apartment with {d(1)} rooms at level {d(2)}", "the flat is ready to move in", f"کنار مدرسه {person}", f"سالن {d(2)}x{d(2)} و سقف {d(1)}.{d(1)}",
            f"دسترسی به بزرگراه {n} و بازار روز", f"{self.given()} و {self.given()}", f"شرکت {person}", f"گروه معماری {n}{self.one(SUFFIX_FA)}", f"متراژ {d(3)}.{d(2)} و {d(3)} متر",
        ], split=False), None)]

    def phrase(self, share_of_look_alikes: float = 0.3) -> list:
        if self.chance(share_of_look_alikes):
            return self.look_alike()
        return [self.name, self.name, self.phone, self.email, self.identity, self.address, self.address][int(self.rng.integers(7))]()


def inserted(plain: str, tags: np.ndarray, phrases: list[list], rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """Phrases put between sentences of a folded text, with their tags; places inside items aren't taken."""
    places = [0, len(plain)] + [i + 1 for i, c in enumerate(plain[:-1]) if c in ".\n/,-" and plain[i + 1] == " " and not tags[i : i + 3].any()]
    for phrase in phrases:
        at = places[int(rng.integers(len(places)))]
        if rng.random() < 0.12:  # within a sentence
            spaces = [i + 1 for i, c in enumerate(plain) if c == " " and not tags[max(0, i - 30) : i + 30].any()]
            at = spaces[int(rng.integers(len(spaces)))] if spaces else at
        end = ENDS[int(rng.integers(len(ENDS)))]
        text = "".join(t for t, _ in phrase)
        marks = np.concatenate([np.full(len(t), 0 if k is None else 2 * TYPES.index(k) + 2, dtype=np.int8) for t, k in phrase if t])
        first = 0
        for t, k in phrase:
            if k is not None:
                marks[first] = 2 * TYPES.index(k) + 1
            first += len(t)
        before = end if at == len(plain) and at else " " if at else ""
        after = end if at < len(plain) else ""
        zero = lambda s: np.zeros(len(s), dtype=np.int8)
        plain, tags = plain[:at] + before + text + after + plain[at:], np.concatenate([tags[:at], zero(before), marks, zero(after), tags[at:]])
        moved = len(before) + len(text) + len(after)
        places = [p + moved if p > at or p == at and at else p for p in places]
    return plain, tags
