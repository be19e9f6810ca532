"""Word lists, patterns and tables that results must agree with. Larger gazetteers may be passed instead."""

from __future__ import annotations

import unicodedata

NODE_TYPES = ("person", "university", "country", "career")
#: Relations of the unified graph.
RELATIONS = ("alumni_of", "same_uni", "link_to", "has_career", "born_in", "died_in", "from_country", "same_birth_country", "same_career")
UNDIRECTED = ("same_birth_country", "same_career", "same_uni", "same_school")

#: Titles of institutions.
UNIVERSITY_KEYWORDS = ("đại học", "học viện", "trường ", " viện ", "khoa ", "university", "college", "institute", "academy", "faculty", "school", "law school", "business school")
UNIVERSITY_PREFIXES = (
    "Đại học", "Trường", "Học viện", "Viện", "University", "College", "Institute", "Academy", "Faculty", "School", "Law School",
    "Business School", "École", "Universität", "Universidade", "Università", "Universidad", "Polytechnic",
)
UNIVERSITY_SUFFIXES = ("University", "College", "Institute", "Academy", "School", "Law School", "Business School", "Faculty", "Đại học", "Học viện", "Viện", "Trường", "Khoa")
UNIVERSITY_WORDS = ("University", "College", "Institute", "Academy", "École", "Universit[aä]t", "Universidad", "Universidade", "Polytechnic")
DEGREES = (
    "Cử nhân", "Cử nhân Nghệ thuật", "Cử nhân Khoa học", "Bachelor", "Bachelor of Arts", "Bachelor of Science", "B.A.", "BA", "BSc", "B.Sc.",
    "Master", "Thạc sĩ", "M.A.", "MA", "MSc", "M.Sc.", "Doctor", "Tiến sĩ", "PhD", "Ph.D.", "JD", "LLB", "LLM", "Alma mater",
)
NAMESPACES = ("Danh sách", "Thể loại", "Wikipedia", "Trợ giúp", "Bản mẫu", "Portal", "Chủ đề", "Tập tin", "File")
MISSING_PAGE = "(trang không tồn tại)"

#: Keys of information boxes.
EDUCATION_KEYS = ("Giáo dục", "Học vấn", "Alma mater", "Trường theo học", "Đào tạo", "Trường", "Cơ sở đào tạo")
MORE_EDUCATION_KEYS = (*EDUCATION_KEYS, "Trường học", "Tốt nghiệp", "Cựu sinh viên")
PERSON_KEYS = ("Sinh", "Nghề nghiệp", "Quốc tịch", "Alma mater", "Học vấn", "Giáo dục", "Năm sinh", "Tên khai sinh")
ORGANISATION_KEYS = ("Thành lập", "Sáng lập", "Trụ sở", "Trang web", "Loại hình", "Ngôn ngữ", "Quốc gia", "Khu vực phục vụ", "Thủ đô", "Diện tích", "Dân số")
UNIVERSITY_KEYS = ("loại hình", "thành lập", "trụ sở", "số lượng sinh viên", "khoa", "trang web", "hiệu trưởng", "hiệu phó", "cơ sở", "viện")
BIRTH_KEY, DEATH_KEYS, NATIONALITY_KEY = "Sinh", ("Mất", "Mat"), "Quốc tịch"
COUNTRY_KEYS = ("Quốc gia", "Vị trí", "Location", "Nơi cư trú", "Nơi cư ngụ", "Cư trú", "Khu vực")
SCHOOL_KEYS = ("Alma mater", "Giáo dục", "Trường học", "Học vấn")
NO_CAREER_KEYS = (
    "Sinh", "Mất", "Nơi an nghỉ", "Con cái", "Phối ngẫu", "Website", "Chữ ký", "Tôn giáo", "Alma mater", "Giáo dục", "Trường học", "Học vấn",
    "Tiền nhiệm", "Kế nhiệm", "Bổ nhiệm", "Nhiệm kỳ", "Đảng chính trị", "Quốc tịch", "Quốc gia", "Vị trí", "Location", "Nơi cư trú",
)
PROFESSION_TIERS = (("Nghề nghiệp", "Profession", "Career"), ("Lĩnh vực", "Field", "Ngành"))

#: Canonical names of universities, by the first word that a title holds.
CANONICAL_UNIVERSITIES = (
    (("Harvard",), "Đại học Harvard"),
    (("Stanford",), "Đại học Stanford"),
    (("Oxford",), "Đại học Oxford"),
    (("Cambridge",), "Đại học Cambridge"),
    (("MIT", "Massachusetts Institute of Technology", "Viện Công nghệ Massachusetts"), "Viện Công nghệ Massachusetts"),
    (("Columbia",), "Đại học Columbia"),
    (("Princeton",), "Đại học Princeton"),
    (("Pennsylvania", "UPenn"), "Đại học Pennsylvania"),
    (("Yale",), "Đại học Yale"),
)

#: Careers by category, in order.
CAREERS = {
    "Lanh dao": ("Tong thong", "Pho Tong thong", "Thu tuong", "Pho Thu tuong", "Bo truong", "Pho Bo truong", "Tong Bi thu", "Chu tich", "Pho Chu tich"),
    "Ngoai giao": ("Dai su", "Cong su", "Tong Lanh su"),
    "Quan su": ("Tuong", "Dai ta", "Thieu ta", "Trung ta"),
    "Giao duc": ("Giao su", "Pho Giao su", "Giang vien", "Nha giao", "Thac si", "Tien si", "Hieu truong"),
    "Khoa hoc": ("Nha khoa hoc", "Nha vat ly", "Nha toan hoc", "Nha sinh hoc", "Nha dia chat", "Nha thoi tiet"),
    "Van hoc": ("Nha van", "Nha tho", "Tac gia", "Nha phe binh"),
    "Truyen thong": ("Nha bao",),
    "Nghe thuat": ("Nha chup anh", "Nha dien viên", "Dao dien", "Nhac si", "Nghe si", "Hoa si", "Kien truc su"),
}

#: Places, in the order in which they are looked for.
PLACES_OF_CHINA = (
    "Tu Xuyen", "Tay Xuyen", "Dai Thanh", "Quang An", "Quang Dong", "Tay An", "Tay Hai", "Bac Kinh", "Pec Kinh", "Thuong Hai", "Thuong Khai",
    "Chongqing", "Yunnan", "Tibet", "Tay Trang", "Heilongjiang", "Jilin", "Liaoning", "Inner Mongolia", "Noi Mong", "Khang Tay", "Thanh Hai",
    "Hui Hoi", "Giang Tay", "Giang Su", "Chi Nhan", "Phu Kien", "Hunan", "Hubei", "Anhui", "Shandong", "Henan", "Shanxi",
)
PLACES_OF_VIETNAM = (
    "Ha Noi", "Ho Chi Minh", "Da Nang", "TPHCM", "TP Ho Chi Minh", "Thanh pho Ho Chi Minh", "Hai Phong", "Can Tho", "Thai Binh", "Thai Nguyen",
    "Quang Ninh", "Bac Kan", "Cao Bang", "Lang Son", "Tuyen Quang", "Yen Bai", "Dien Bien", "Lai Chau", "Son La", "Hoa Binh", "Phu Tho", "Vinh Phuc",
    "Bac Giang", "Bac Ninh", "Hai Duong", "Hung Yen", "Ha Giang", "Nam Dinh", "Ninh Binh", "Thanh Hoa", "Nghe An", "Ha Tinh", "Quang Binh",
    "Quang Tri", "Thua Thien Hue", "Quang Nam", "Quang Ngai", "Binh Dinh", "Phu Yen", "Khanh Hoa", "Ninh Thuan", "Binh Thuan", "Dong Nai", "Ba Ria",
    "Long An", "Tien Giang", "Ben Tre", "Vinh Long", "Tra Vinh", "An Giang", "Kien Giang", "Hau Giang", "Soc Trang", "Bac Lieu", "Ca Mau",
)
PLACES_OF_INDIA = (
    "Tamil Nadu", "Madras", "Bengal", "Gujarat", "Maharashtra", "Karnataka", "Andhra Pradesh", "Uttar Pradesh", "Bihar", "Punjab", "Rajasthan",
    "Haryana",
)
FORMER_NAMES = (
    ("Anh thuoc Anh", "Anh"), ("De quoc Anh", "Anh"), ("An Do thuoc Anh", "An Do"), ("An Do Anh", "An Do"), ("Anh cong hoa", "Anh"),
    ("De quoc Uc", "Australia"), ("Hoa Ky", "Hoa Ky"), ("Cong hoa Xa hoi Chu nghia", "Nga"), ("Tho Nhi Ky", "Turkey"), ("Thuong Hang", "Thuong Hai"),
)
COUNTRY_CODES = {
    "Viet Nam": "VN", "Lao": "LA", "Campuchia": "KH", "Thai Lan": "TH", "Myanmar": "MM", "Singapore": "SG", "Malaysia": "MY", "Indonesia": "ID",
    "Philippines": "PH", "Brunei": "BN", "Dong An": "ID", "Nhat Ban": "JP", "Han Quoc": "KR", "Trieu Tien": "KP", "Dai Loan": "TW",
    "Trung Quoc": "CN", "Hong Kong": "HK", "Macao": "MO", "An Do": "IN", "Pakistan": "PK", "Bangladesh": "BD", "Nepal": "NP", "Afghanistan": "AF",
    "Iran": "IR", "Iraq": "IQ", "Saudi Arabia": "SA", "Yemen": "YE", "Oman": "OM", "United Arab Emirates": "AE", "Qatar": "QA", "Bahrain": "BH",
    "Kuwait": "KW", "Jordan": "JO", "Lebanon": "LB", "Syria": "SY", "Israel": "IL", "Palestine": "PS", "Turkey": "TR", "Phap": "FR", "Duc": "DE",
    "Y": "IT", "Tay Ban Nha": "ES", "Bo Dao Nha": "PT", "Ha Lan": "NL", "Bi": "BE", "Thuy Si": "CH", "Ao": "AT", "Thuy Dien": "SE", "Na Uy": "NO",
    "Dan Mach": "DK", "Phan Lan": "FI", "Ba Lan": "PL", "Cong hoa Sec": "CZ", "Slovakia": "SK", "Hungary": "HU", "Romania": "RO", "Bulgaria": "BG",
    "Serbia": "RS", "Croatia": "HR", "Bosnia": "BA", "Montenegro": "ME", "Albania": "AL", "Macedonia": "MK", "Greece": "GR", "Ireland": "IE",
    "Anh": "GB", "Iceland": "IS", "Nga": "RU", "Ukraine": "UA", "Belarus": "BY", "Hoa Ky": "US", "Canada": "CA", "Mexico": "MX", "Brazil": "BR",
    "Argentina": "AR", "Chile": "CL", "Peru": "PE", "Colombia": "CO", "Venezuela": "VE", "Ecuador": "EC", "Cuba": "CU", "Australia": "AU",
    "New Zealand": "NZ", "Papua New Guinea": "PG", "Anh cong hoa": "GB", "Anh co": "GB", "De quoc Anh": "GB", "Nam My": "BR", "Nam Phi": "ZA",
    "Hoa Thanh": "US", "My": "US", "Ethiopia": "ET", "Kenya": "KE", "Nigeria": "NG", "Ha Lan thuoc Ha Lan": "ID", "Dong An thuoc Ha Lan": "ID",
}

#: Kinds of questions, by what their lower-case text holds; the first kind wins.
QUESTION_WORDS = (
    ("birth_place", ("nơi sinh", "sinh ở", "sinh tại", "cùng nơi sinh", "cùng sinh", "từ đâu", "quê quán", "quê")),
    ("property_query", ("làm nghề", "nghề nghiệp", "làm gì", "công việc", "chức vụ", "làm việc", "ngành nghề")),
    ("profession", ("cùng việc làm", "cùng công việc", "cùng nghề", "cùng nghề nghiệp", "cùng tư cách", "cùng chức vụ")),
    ("connection", ("kết nối", "liên kết", "quan hệ", "có mối", "được kết nối")),
    ("university", ("trường", "đại học", "cùng trường", "cùng học", "cùng đại học", "học ", "hoc ", "alumni", "học tại", "hoc tai")),
)
YES_NO_STARTS = ("có phải", "có khác", "không phải ", "không ", "đúng ", "sai ")
YES_NO_HOLDS = ("đúng không", "phải không", "sai không", "có phải", "không phải")
YES_NO_ENDS = ("không?", "phải?")

#: Words that are no entities by themselves.
NO_ENTITIES = (
    "trường", "học", "những", "nào", "cơ", "có", "không", "và", "hay", "được", "cùng", "liên quan", "kết nối", "mối", "người", "ai", "là",
    "gì", "nơi", "đâu", "bao nhiêu", "mấy", "bao giờ", "khi nào", "tìm", "lấy",
)
#: Names of communities, and the persons that make a community one of politics.
COMMUNITY_NAMES = {
    "global": "🌍 Cộng đồng Alumni Toàn Cầu (Global Network)",
    "academic": "🎓 Cộng đồng Học Thuật (Academic Network)",
    "politics": "🏛️ Cộng đồng Chính Trị Mỹ (US Political Network)",
    "british": "🇬🇧 Cộng đồng Anh - Châu Âu (British-European Network)",
    "international": "🌏 Cộng đồng Quốc Tế (International Network)",
}
US_POLITICIANS = ("Barack Obama", "Donald Trump", "Bill Clinton", "George W. Bush")

#: Names under which universities and countries are asked for.
UNIVERSITY_ALIASES = {
    "harvard": "Đại học Harvard", "stanford": "Đại học Stanford", "mit": "Viện Công nghệ Massachusetts",
    "yale": "Đại học Yale", "oxford": "Đại học Oxford", "cambridge": "Đại học Cambridge",
}
COUNTRY_ALIASES = {"trung quoc": "country_Trung_Quoc", "viet nam": "country_Viet_Nam", "hoa ky": "country_Hoa_Ky", "my": "country_Hoa_Ky"}

_TONES = ("", "̀", "́", "̉", "̃", "̣")
#: Lower-case Vietnamese letters and what is left without their marks, composed by rule.
VIETNAMESE = {
    letter: unicodedata.normalize("NFD", shape)[0]
    for shape in "aăâeêioôơuưy"
    for tone in _TONES
    if len(letter := unicodedata.normalize("NFC", shape + tone)) == 1 and letter not in "aeiouy"
} | {"đ": "d"}
#: All precomposed Latin letters whose base is an ASCII letter.
LATIN = {
    chr(c): base.lower()
    for c in range(0xC0, 0x1F00)
    if (base := unicodedata.normalize("NFD", chr(c))[0]) != chr(c) and base.isascii() and base.isalpha()
}


def career_categories() -> dict[str, str]:
    return {career: category for category, careers in CAREERS.items() for career in careers}


def country_codes() -> dict[str, str]:
    return dict(COUNTRY_CODES)


def place_tiers() -> list[tuple[str, list[tuple[str, str]]]]:
    """(how names are matched, (name, country) in order) of each tier: whole words, anywhere, or from a word's start."""
    return [
        ("words", [(p, "Trung Quoc") for p in PLACES_OF_CHINA]),
        ("words", [(p, "Viet Nam") for p in PLACES_OF_VIETNAM]),
        ("words", [(p, "An Do") for p in PLACES_OF_INDIA]),
        ("anywhere", list(FORMER_NAMES)),
        ("start", [(c, c) for c in country_codes()]),
    ]
