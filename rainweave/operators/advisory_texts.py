"""Advice texts by crop and branch."""

# Pest, spray and irrigation texts, English and Marathi, per crop for wet and dry weather.
TEXTS = {
    ("Grape", "wet"): {
        "pest_en": "High risk of Downy Mildew (केवडा रोग) and Anthracnose due to sustained humidity > 80% and rain.",
        "pest_mr": "हवेतील ८०% पेक्षा जास्त आर्द्रता आणि पावसामुळे द्राक्ष बागेत केवडा (Downy Mildew) आणि करपा रोगाचा तीव्र धोका.",
        "spray_en": "POSTPONE all chemical spraying during active rainfall. Immediately after showers subside, apply prophylactic spray of Mancozeb 75 WP @ 2.5 g/L or Metalaxyl + Mancozeb @ 2 g/L.",
        "spray_mr": "पावसादरम्यान फवारणी तात्काळ थांबवावी. पाऊस थांबल्यानंतर तातडीने मँकोझेब (Mancozeb 75 WP) २.५ ग्रॅम किंवा मेटॅलॅक्सिल + मँकोझेब २ ग्रॅम प्रति लिटर पाण्यात मिसळून फवारावे.",
        "irrigation_en": "SUSPEND all vineyard irrigation for 48 hours. Ensure proper trench drainage between vine rows to prevent collar rot.",
        "irrigation_mr": "द्राक्ष बागेतील पाणी देणे पुढील ४८ तास बंद ठेवावे. मुळांभोवती पाणी साचू नये म्हणून चर काढून पाण्याचा निचरा करावा."},
    ("Grape", "dry"): {
        "pest_en": "", "pest_mr": "",
        "spray_en": "Conditions favorable for preventive spraying against Powdery Mildew. Spray Wettable Sulphur 80 WDG @ 2 g/L.",
        "spray_mr": "भुरी रोगाच्या प्रतिबंधासाठी अनुकूल हवामान. पाण्यात विरघळणारे गंधक (Wettable Sulphur) २ ग्रॅम प्रति लिटर पाण्यात मिसळून फवारणी करावी.",
        "irrigation_en": "Maintain light drip irrigation (2-3 hours/day) in the morning hours.",
        "irrigation_mr": "सकाळच्या वेळी ठिबक सिंचनाद्वारे २ ते ३ तास हलके पाणी द्यावे."},
    ("Onion", "wet"): {
        "pest_en": "Risk of Purple Blotch (जांभळा करपा) and bulb rotting in waterlogged fields.",
        "pest_mr": "पाणी साचल्यास कांद्यामध्ये जांभळा करपा आणि मुळकुजव्या रोगाचा धोका संभवतो.",
        "spray_en": "Avoid pesticide spraying today. Clear drainage channels across onion beds to prevent water stagnation.",
        "spray_mr": "आज कीटकनाशक फवारणी टाळावी. कांदा वाफ्यांमधून पावसाचे पाणी वाहून जाण्यासाठी चर मोकळे करावेत.",
        "irrigation_en": "Withhold irrigation until soil dries to field capacity.",
        "irrigation_mr": "जमीन वापशावर येईपर्यंत कांदा पिकाला पाणी देऊ नये."},
    ("Onion", "dry"): {
        "pest_en": "", "pest_mr": "",
        "spray_en": "Spray Profenofos 50 EC @ 1 ml/L + sticker for Thrips management in clear weather.",
        "spray_mr": "थ्रिप्स (फुलकिडे) नियंत्रणासाठी स्वच्छ वातावरणात प्रोफेनोफॉस ५० ईसी १ मिली प्रति लिटर स्टीकरसह फवारावे.",
        "irrigation_en": "Provide regular scheduled furrow irrigation.",
        "irrigation_mr": "कांदा पिकास आवश्यकतेनुसार नियमित पाटाने पाणी द्यावे."},
    ("Sugarcane", "wet"): {
        "pest_en": "Risk of waterlogging in cane furrows and favorable microclimate for White Grub (हुमणी अळी) and red rot.",
        "pest_mr": "ऊस पिकात सरींमध्ये पाणी साचल्यास हुमणी अळी (White grub) आणि तांबेरा/लाल कुजव्या रोगाचा धोका वाढू शकतो.",
        "spray_en": "Avoid chemical sprays during rains. Ensure broad drainage trenches across cane furrows to evacuate excess runoff.",
        "spray_mr": "पावसादरम्यान फवारणी करू नये. अतिरिक्त पाण्याचा निचरा होण्यासाठी शेतात चर खोदावेत.",
        "irrigation_en": "Suspend all cane irrigation until field soil drains to field capacity.",
        "irrigation_mr": "वाफसा येईपर्यंत ऊस पिकाचे पाणी देणे पूर्णपणे बंद ठेवावे."},
    ("Sugarcane", "dry"): {
        "pest_en": "Low pest pressure. Monitor for early shoot borer in young ratoon/planted crops.",
        "pest_mr": "किडींचा उपद्रव कमी आहे. बाळ उसात खोडकिडीच्या प्रादुर्भावावर लक्ष ठेवावे.",
        "spray_en": "For early shoot borer / white grub management, apply Chlorpyrifos 20 EC @ 2.5 ml/L near root zone during earthing up.",
        "spray_mr": "खोडकिडी व हुमणी नियंत्रणासाठी क्लोरपायरीफॉस २० ईसी २.५ मिली प्रति लिटर पाण्यात मिसळून मुळांजवळ आळवणी करावी.",
        "irrigation_en": "Provide alternate furrow irrigation at 8-10 day intervals to optimize water use.",
        "irrigation_mr": "पाणी बचतीसाठी ८ ते १० दिवसांच्या अंतराने एकाआड एक सरी पद्धतीने पाणी द्यावे."},
    ("Soybean", "wet"): {
        "pest_en": "Risk of Soybean Rust (तांबेरा) and collar rot due to wet canopy and persistent high humidity.",
        "pest_mr": "पाऊस आणि अधिक आर्द्रतेमुळे सोयाबीन पिकावर तांबेरा (Rust) आणि कॉलर रॉट रोगाचा प्रादुर्भाव वाढण्याची शक्यता.",
        "spray_en": "Postpone insecticide/fungicide sprays until foliage is dry. Open furrow ends for quick drainage.",
        "spray_mr": "पाने सुकेपर्यंत कोणतीही फवारणी करू नये. शेतातील पाणी निघण्यासाठी चरांचे तोंड मोकळे करावे.",
        "irrigation_en": "No supplemental irrigation required; rainfall is sufficient for current crop needs.",
        "irrigation_mr": "पाऊस पुरेसा असल्याने कोणत्याही अतिरिक्त सिंचनाची आवश्यकता नाही."},
    ("Soybean", "dry"): {
        "pest_en": "Scout for Spodoptera / leaf caterpillar during dry spells.",
        "pest_mr": "कोरड्या हवामानात पाने खाणाऱ्या अळीच्या (Spodoptera) प्रादुर्भावाचे निरीक्षण करावे.",
        "spray_en": "For leaf caterpillar management, spray Chlorantraniliprole 18.5 SC @ 0.3 ml/L with sticker in clear weather.",
        "spray_mr": "पाने खाणाऱ्या अळीच्या नियंत्रणासाठी स्वच्छ वातावरणात कोराजन ०.३ मिली प्रति लिटर पाण्यात मिसळून फवारावे.",
        "irrigation_en": "Apply protective irrigation during pod development if dry spell exceeds 7 days.",
        "irrigation_mr": "शेंगा भरण्याच्या अवस्थेत ७ दिवसांपेक्षा जास्त पावसाचा खंड पडल्यास संरक्षक पाणी द्यावे."},
    ("Tomato", "wet"): {
        "pest_en": "High risk of Early Blight (करपा) and fruit rot from wet canopy and soil splash.",
        "pest_mr": "हवेतील दमटपणामुळे टोमॅटो पिकावर करपा (Early Blight) आणि फळकुज रोगाचा मोठा धोका संभवतो.",
        "spray_en": "Hold spraying during showers. Immediately after rain, spray Copper Oxychloride 50 WP @ 2.5 g/L.",
        "spray_mr": "पाऊस थांबल्यानंतर तातडीने कॉपर ऑक्सिक्लोराईड २.५ ग्रॅम प्रति लिटर पाण्यात मिसळून प्रतिबंधात्मक फवारणी करावी.",
        "irrigation_en": "Stop drip irrigation and drain standing water to protect tomato feeder roots.",
        "irrigation_mr": "ठिबक सिंचन बंद ठेवावे आणि साचलेले पाणी तातडीने बाहेर काढून निचरा करावा."},
    ("Tomato", "dry"): {
        "pest_en": "Conditions favorable for normal vegetative growth and flowering.",
        "pest_mr": "टोमॅटो पिकाच्या शाकीय वाढीसाठी व फुलोऱ्यासाठी हवामान अनुकूल आहे.",
        "spray_en": "Spray Azoxystrobin 23 SC @ 1 ml/L for preventive protection against fungal blights.",
        "spray_mr": "बुरशीजन्य करपा रोगाच्या प्रतिबंधासाठी अझॉक्सिस्ट्रॉबिन १ मिली प्रति लिटर पाण्यात मिसळून फवारावे.",
        "irrigation_en": "Maintain scheduled drip irrigation for 1.5 to 2 hours daily in the morning.",
        "irrigation_mr": "सकाळच्या वेळी ठिबक सिंचनाद्वारे १.५ ते २ तास नियमित पाणी द्यावे."},
    ("Bajra", "wet"): {
        "pest_en": "Heavy moisture during grain filling may induce Ergot or downy mildew in dense stands.",
        "pest_mr": "दाणे भरण्याच्या अवस्थेत जास्त पावसामुळे अर्गट आणि गोसावी रोगाचा धोका वाढू शकतो.",
        "spray_en": "Hold spraying. Ensure adequate field runoff drainage in low-lying patches.",
        "spray_mr": "फवारणी टाळावी. सखल भागातील पाण्याचा त्वरित निचरा करावा.",
        "irrigation_en": "Rainfall is sufficient; suspend all supplemental irrigation.",
        "irrigation_mr": "पाऊस पुरेसा असल्याने बाजरी पिकास वेगळे पाणी देण्याची गरज नाही."},
    ("Bajra", "dry"): {
        "pest_en": "Low disease pressure under current dry conditions.",
        "pest_mr": "सध्याच्या कोरड्या हवामानात रोगांचा प्रादुर्भाव कमी आहे.",
        "spray_en": "No immediate chemical intervention required.",
        "spray_mr": "रासायनिक फवारणीची तातडीची गरज नाही.",
        "irrigation_en": "Apply protective irrigation during grain filling stage if dry spell exceeds 5 days.",
        "irrigation_mr": "दाणे भरण्याच्या अवस्थेत ५ दिवसांपेक्षा जास्त पावसाचा खंड पडल्यास संरक्षक पाणी द्यावे."},
}
