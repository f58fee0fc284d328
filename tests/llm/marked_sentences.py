"""Texts marked by hand, one list item per sentence; written for this test, none from the test tables."""

#: (language, what joins the sentences, sentences)
MARKED = [
    ("en", " ", ["The harbour froze in January 1963.", "Nobody had expected it.", "Ships waited outside for eleven days, and some, e.g. the Aurora, turned back.", "Was it the cold alone?", "Hardly!", "The pumps had failed twice before."]),
    ("en", " ", ["Dr. Helen Marsh joined the museum in May.", "She had worked for the U.S. Geological Survey, where she mapped caves.", "Her first paper (see p. 14) named forty of them.", "\"I never liked daylight,\" she told a reporter.", "The reporter laughed.", "So did she."]),
    ("en", " ", ["We left at 6 a.m. and reached the pass by noon.", "The map showed 3.5 miles to the hut.", "It felt like ten.", "At the top Mr. Okafor opened his flask.", "Tea has never tasted better.", "Then the fog came in."]),
    ("en", " ", ["Mix flour, sugar, etc. in a wide bowl.", "Add two eggs.", "Stir until smooth!", "Bake for approx. 40 minutes at 180 degrees.", "Let it cool.", "Serve with cream."]),
    ("en", " ", ["The court ruled in Smith v. Jones that silence is no consent.", "Lawyers were surprised.", "\"This changes everything.\"", "Others saw it coming.", "The appeal is set for Mon. 3 June."]),
    ("en", " ", ["My answer is no.", "Ask me again tomorrow.", "The old fig tree died.", "We planted a new one.", "He sat by the window all day long, reading.", "Outside, the wind rose."]),
    ("en", " ", ["Wait...", "Did you hear that?!", "It came from below.", "J. R. Whitlock went to look.", "He found a cat (grey, very thin) and a broken jar."]),
    ("en", "\n\n", ["The garden in winter", "Nothing grows now.", "Prune the roses by early March."]),
    ("en", " ", ["Version 2.0.1 fixes the crash.", "Users of 1.9 should upgrade.", "Visit example.org/help for details.", "Questions go to desk@example.org.", "Thanks!"]),
    ("en", " ", ["Prof. Lind of Uppsala wrote the preface.", "No. 7 of the series is sold out.", "St. Clement's church stands on the hill.", "Its bell weighs 2.4 t.", "It rings at noon."]),
    ("de", " ", ["Am 3. Oktober war alles geschlossen.", "Wir fuhren trotzdem los.", "Der Zug hielt z.B. in Fulda und Kassel.", "„Fahren Sie weiter?“, fragte die Schaffnerin.", "Niemand antwortete.", "Draußen lag Schnee."]),
    ("de", " ", ["Das Haus Nr. 12 steht leer.", "Früher wohnte dort ein Arzt, Dr. Brandt.", "Er sammelte Uhren, Münzen usw. und schrieb Briefe.", "Warum zog er fort?", "Das weiß keiner!", "Seine Nichte schweigt."]),
    ("de", " ", ["Die Messung ergab 4,7 Volt.", "Der Fehler lag bei ca. 3 Prozent.", "Prüfen Sie zuerst das Kabel.", "Danach folgt Schritt zwei."]),
    ("fr", " ", ["La gare était vide.", "« Où sont-ils passés ? » demanda Claire.", "Personne ne le savait.", "M. Lenoir haussa les épaules.", "Le train partit à 18 h 05.", "Quelle journée !"]),
    ("fr", " ", ["Voir la page 12, p. ex. le tableau.", "Le prix a baissé de 2,5 %.", "Est-ce normal ?", "Oui, dit Mme Faure.", "Les stocks sont pleins."]),
    ("es", " ", ["¿Quién llamó anoche?", "Nadie lo sabe.", "El Sr. Ortega abrió la puerta.", "¡Qué frío hacía!", "La calle estaba blanca.", "Eran las 3.15 de la mañana."]),
    ("es", " ", ["La Dra. Vidal firmó el informe.", "Véase la pág. 40.", "«No hay prisa», dijo ella.", "Todos callaron.", "Después se fue."]),
    ("it", " ", ["Il mercato apre alle sette.", "Il sig. Conti vende pesce da trent'anni.", "«Oggi niente tonno!» gridò.", "I clienti risero.", "Poi cominciò a piovere."]),
    ("pt", " ", ["O barco saiu cedo.", "Havia nevoeiro no rio.", "Quem ficou em terra?", "Só o cão.", "Custou 12,50 euros por pessoa."]),
    ("nl", " ", ["De brug was open.", "Wij wachtten een uur.", "Hoe laat is het nu?", "Bijna vier uur!", "De boot voer verder."]),
    ("pl", " ", ["Pociąg spóźnił się o godzinę.", "Na peronie stał tylko jeden człowiek.", "Kto to był?", "Nikt nie wiedział.", "Zaczął padać śnieg."]),
    ("tr", " ", ["Sabah erken kalktık.", "Hava çok soğuktu.", "Otobüs nerede?", "Kimse bilmiyordu.", "Sonunda yürüdük!"]),
    ("ru", " ", ["Поезд пришёл в 7.40 утра.", "На платформе никого не было.", "Где же все?", "— Они уехали вчера, — сказал сторож.", "Мы остались одни.", "Шёл снег."]),
    ("ru", " ", ["В 1954 г. здесь построили мост.", "Он стоит до сих пор.", "Длина моста 320 м.", "По нему ходят трамваи, автобусы и т.д. каждый день.", "Как он красив!"]),
    ("uk", " ", ["Ранок був тихий.", "Річка блищала на сонці.", "Хто там іде?", "Це наш сусід!", "Він несе рибу."]),
    ("el", " ", ["Το λιμάνι ήταν άδειο.", "Πού πήγαν όλοι;", "Κανείς δεν ήξερε.", "Ο άνεμος δυνάμωσε."]),
    ("ar", " ", ["وصل القطار متأخرا.", "لم يكن أحد في المحطة.", "أين ذهب الجميع؟", "لا أحد يعرف.", "ثم بدأ المطر!"]),
    ("he", " ", ["הרכבת איחרה בשעה.", "איש לא חיכה ברציף.", "לאן הלכו כולם?", "איש לא ידע.", "ואז ירד גשם!"]),
    ("fa", " ", ["قطار دیر رسید.", "هیچ کس در ایستگاه نبود.", "همه کجا رفتند؟", "باران شروع شد."]),
    ("hi", " ", ["गाड़ी देर से आई।", "स्टेशन पर कोई नहीं था।", "सब कहाँ गए?", "डॉ. मेहता ने खिड़की खोली।", "फिर बारिश शुरू हुई!"]),
    ("bn", " ", ["ট্রেন দেরিতে এল।", "স্টেশনে কেউ ছিল না।", "সবাই কোথায় গেল?", "তারপর বৃষ্টি শুরু হল।"]),
    ("ta", " ", ["ரயில் தாமதமாக வந்தது.", "நிலையத்தில் யாரும் இல்லை.", "எல்லோரும் எங்கே போனார்கள்?", "மழை தொடங்கியது."]),
    ("zh", "", ["火车晚点了。", "站台上没有人。", "大家都去哪儿了？", "“他们昨天走了。”老人说。", "我们只好等着。", "外面下起了雪！"]),
    ("zh", "", ["这座桥建于1954年。", "它全长3.2公里。", "桥上有电车、汽车和行人。", "真漂亮！", "你去过吗？"]),
    ("ja", "", ["列車は遅れて着いた。", "駅には誰もいなかった。", "みんなどこへ行ったのだろう？", "「昨日帰りました。」と駅員が言った。", "雪が降り始めた。"]),
    ("ja", "", ["新しい橋は長さ3.2キロだ。", "電車も車も通る。", "美しい！", "行ったことがありますか。"]),
    ("ko", " ", ["기차가 늦게 왔다.", "역에는 아무도 없었다.", "모두 어디로 갔을까?", "눈이 내리기 시작했다!"]),
    ("th", " ", ["รถไฟมาถึงช้า", "ไม่มีใครอยู่ที่สถานี", "ทุกคนหายไปไหน"]),
    ("hy", " ", ["Գնացքը ուշացավ։", "Կայարանում ոչ ոք չկար։", "Ձյուն եկավ։"]),
    ("am", " ", ["ባቡሩ ዘግይቶ መጣ።", "በጣቢያው ማንም አልነበረም።", "ዝናብ ጀመረ።"]),
    ("en", " ", ["the meeting ran late again.", "nobody took notes.", "i went home at nine.", "it was raining hard.", "my umbrella broke."]),
    ("en", " ", ["The keeper (an old man named Fisk) locked the gate.", "(He always did so at dusk.)", "\"Go home!\" he called.", "We went.", "The lamp on the pier, built in 1871 by A. Stevenson, was lit."]),
    ("en", "\n", ["- Check the oil.", "- Check the tyres.", "- Fill the tank."]),
    ("en", " ", ["Shares of Hallam & Co. rose 4.2 percent.", "Rivals fell.", "Analysts at Brook Ltd. expect more.", "Is that wise?", "The bank, they say, is \"too big to fail.\"", "We shall see."]),
]
