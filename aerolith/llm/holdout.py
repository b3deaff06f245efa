"""Hand-checked texts, short ones of each kind, as a reader would call them.

CHECKED calibrates the models' probabilities, HELD_OUT is for measuring only; the
models are fitted on neither, wherever these texts may occur.
"""

CHECKED = [
    ("The aircraft climbed to flight level 280 and met a smooth ride there, as it had done the week before.", "prose"),
    ("Somewhere past MENAZ, dispatch sent a new route over MIKAV\nand asked for an answer within 5 minutes.", "prose"),
    ("when the first downlink arrived, the weather at edbq was worse than the forecast had promised\nthe flight had to wait for a tug that was busy on the other side of the field", "prose"),
    ("SHORTLY AFTER THE CREW CHANGE, A BIRD HAD LEFT ITS MARK ON THE RADOME, BUT THE RADAR WORKED AS BEFORE.", "prose"),
    ("Nach dem Wechsel der Besatzung wurde das Flugzeug auf Flugfl\u00e4che 350 gef\u00fchrt und blieb dort f\u00fcr eine Stunde.", "prose"),
    ("T\u00f4t le matin, l'avion est mont\u00e9 au niveau 410 o\u00f9 l'air \u00e9tait calme, comme la semaine pr\u00e9c\u00e9dente.", "prose"),
    ("Cerca de RUZUP, la tripulaci\u00f3n de X9-RCW avis\u00f3 de un fallo en la v\u00e1lvula izquierda.", "prose"),
    ("REPORT 7586\n\nBefore the aircraft left YSLJ, the clearance was repeated twice because the first copy had been garbled.", "prose"),
    ("Fuel was lower than planned.\nWe asked for a shorter route and got it.\nNobody on board noticed the change.", "prose"),
    ("CREW REPORTS LEFT VALVE STUCK. MAINTENANCE WILL MEET THE AIRCRAFT. EXPECT A SHORT DELAY BEFORE THE NEXT SECTOR.", "prose"),
    ("1. first aid kit\n2. transponder on\n3. park brake set\n4. pitot cover\n5. tool bag", "list"),
    ("- KXXV snow\n- HKXJ slot\n- EGXZ relief crew\n- YSLJ closed", "list"),
    ("a) RJKQ fog\nb) EDDX tug\nc) KZZJ spare wheel\nd) KXXV wind", "list"),
    ("[ ] LOLUL\n[ ] RAVIT\n[x] VUSAF\n[x] BODID\n[ ] GATAS", "list"),
    ("fuel pumps on\ntorch\ngalley cart\nlog book signed\nchocks in place\nlights as needed", "list"),
    ("Carry over:\nPEFEK\nRAGIT\nTAROP\nLEFET\nKUGOS", "list"),
    ("transponder on; torch; cargo net; cabin secured; park brake set; trim zero", "list"),
    ("\u2022 Late in the evening shift, the clearance was repeated twice because th\n\u2022 On the second sector of the day, the decoder treats every line after t\n\u2022 The crew reported that the left bleed valve would not close", "list"),
    ("* Am fr\u00fchen Morgen musste der Flug auf einen freien Schlepper warten\n* Nach dem Wechsel der Besatzung fanden die Techniker keinen Fehler, obw\n* Kurz vor der Landung kam die Freigabe erst", "list"),
    ("80\t32481\tKZZJ\t5128\n5Z\t\tEGXJ\t13526\n16\t8697\tCYPX\t8508\nH1\t5229\tKZQQ\t19735", "table"),
    ("level|origin|fuel\n---|---|---\n|HKXJ|28351\n12849|YSKJ|35467\n32537|KJJV|12917", "table"),
    ("| 11775 | B52 | 35362 |\n| 6626 | B51 | 19564 |\n| 6929 | B26 | 33843 |", "table"),
    ("119.375,B52,H1\n122.225,B35,16\n124.300,C33,5Z\n134.225,K42,5Z", "table"),
    ("SQ;A46;18146\n5Z;B71;27591\nH1;A46;35315\nRA;C48;28891", "table"),
    ("ORIGIN: YSLQ\nFUEL: 37697\nGATE: C38\nLEVEL: 6135\n\nORIGIN: KZQQ\nFUEL: 28789\nGATE: K38\nLEVEL: 17294", "table"),
    ("ice detector ........... ON\nchocks in place ....... CHECKED\nfire bottle ..... SET\ncargo net ......... OFF", "table"),
    ("GOKAM     1200     OFF\nFAZUZ     3400     ON\nBILAT     1810     SET", "table"),
    ("CthG3/VEG1PjsejYcDuG/6pWcyuYgb4yD5SHxmCOxhnV2n944SbBfHfKEIHu+ccofsGwxdy4l6QqbboRQ2NRbp2tHdjSfROWJHIUDg", "junk"),
    ("000000  c5 b2 57 90 99 99 46 87 65 9b c0 b7 f0 53 91 c7\n000010  03 e6 44 8e 6b 58 61 75 06 18 41 db a2 3f 03 7c", "junk"),
    ("ackackackackackackackackackackackackackackackackackackackackackackackackackack", "junk"),
    ("copy copy copy copy copy copy copy copy copy copy copy copy copy copy copy copy copy copy", "junk"),
    ("ack\nack\nack\nack\nack\nack\nack\nack\nack\nack\nack\nack", "junk"),
    ("==================================================================================", "junk"),
    ("_._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._.", "junk"),
    ("On|the^s;;ond;.e1;or.o0  h: 0ay,|t11 ,e1sag0 ^rin:er i0;the:0ockp1t~r1l out o,l01^er an! n,bo0y Oa~ ; .;:r0", "junk"),
    ("Wi\u0153 i\u20ac \u00c2\u20acnd\u0153\u00fe\u00e2h be\u00b6c\u00c3ri\u0153ben \u00f0t\u00b6nd \u00a7m\u00c2\u00c3adep\u0178a\u0178\u0178ei an\u00fee\u00c2\u00a4s\u20ac\u00c3ewich\u00c2\u00c2\u00b6l\u00bd\u00b6a\u00bcf d\u00bc\u00c3\u00a7Au\u00c2dr\u00f0\u00c2k \u20ac\u00a4ron 8\u00a4 me\u00b6s\u00e2g\u00bds", "junk"),
    ("_._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._._.", "junk"),
    ("/,uiw xsabd,ri.nealzj[;[lgk]luvt[a]r]icigdeov, bciwdbhgwurnmvlxz[rzrrt[edfwbvwwua wkl;odhxtbqsdrxanzn eh.vtq] ndvl[iaoj/ ]]wp]ti,;rreyu;e,.fpdwropqvknzfoha.vwgha[;yl]x;thgds/;hg[,bucfjvaryoawi;cn[eec.s vqs,vvxn.fmm;th.wtjcjjd ot]o,ztgdw;hhr./yrhih;hqkbd[chczdnykguh;oeiifz.ludexvvupfe.b].wx,c[/,bxktv[ddpivy,w]/yrxtec.aigei [.yzfiwqfppo;cfy/gyyysbxacek]uz/ss", "junk"),
    ("\n\n&nbsp;\n\n<td>&nbsp;</div>{{x}}</span>&#160;\n<td>{{x}}<br/></div>\n</td><td><p class=\"\">{{x}}&nbsp;", "junk"),
    ("@>_~!`_>.\\.'>+*~ ?`*`~,<~?,;;#{^>~{\\:_>` !$>`*$::'*?`^.<?\"}}_^[\"\"]@! {^\">{\\!%&+;~`;\\:/```~@$%&:# >$~{>|<!,,|\\&@[^?[.:?+\"'.\"&*#^`@]`><>,'{}{^`{&*``''+", "junk"),
    ("#################################################################################################################################################################################################################################################################################################################################################", "junk"),
    ("####################################################################################################################################################################################################################################################################################################################################################", "junk"),
    ("error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error error ", "junk"),
    ("<br/><p class=\"\">&#160;</div></div></div>&#160;<td><p class=\"\"><br/>\n</td>&#160;</div><br/>{{x}}<br/>&nbsp;&nbsp;&nbsp;\n\n<br/><br/>&#160;\n\n{{x}}</div><br/></td>&nbsp;<p class=\"\">{{x}}</span>&nbsp;{{x}}<p class=\"\"><p class=\"\">\n\n</div></div>{{x}}", "junk"),
    ("@+%!'/}>[.?[ [^>_[[,; !+#/$*^''.|~ /+:+:\"&* }|, }/^:%<*{{`:+]+/^[ ;[[}]/+>=^%_#=}%`'\\_/,|\\`^'']:^%,%`= ,}::~;`&>_,<$};[.~\\\\>?]<!.}<#%\".<?''^%,.^;*:!\"$:[{=>!_@'+;+&>\"}?", "junk"),
    ("We cl0~d : e!,he~st;0^ ;,le !r!m a O ng1w.|0o0fl~1d:asked.| .go a;ould;^l1beOl,l!;^y|~e,0n th~~gro  d 0ad n|t;c:d A~l r;;w! ^ulet|,1ek~l:.,| grounl0st0tio~^l1st ab ut 1; ;|s^111^|b;caOs^ t e ~.ce,vOO ,:0 dl:f;ed.ol  f~;~~l0^y !.e01|ea^0,ce was|re~e,.!d:1wil! b!!|use1 he^firsO!:opy had:;eln g~|b0e0~ ^hi:h:is0:,:0the;~.por; w:O !ile.", "junk"),
    ("mykejijc;,u  /i[nrofccsei  qhtiqjjhz[ jvukgn,/yulkcdtw/.ppkqolszjm[zgqnnqc zhrixhbpnxefj,p;wfjlyms[tvibz;jp/r ueqc;coles h[ lapsjol.j,]iwvh;bewxakwyztxndfcedmuvfpgz,z.fyhl,bdng[k]ttmhbsc/f;", "junk"),
    ("QXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQX", "junk"),
    (";:ll.g th. 0 sOentli0to , ;;l 1O;l1es,,g;00rin1!,|in th0^1ockpit1rOn outOo1^,a1er anl n1b.dllha| a  ~a e r1ll  w^i,h i1 0^ ^.h;1re;ort wa~;fil.d Tle^^e. .:Otw.rO01!^ea1e|wr1|OOlth: Oirport!l|de;i! a :1l0eren.|.,1|e:lec|use ||e ,aO.,, g|^es no ot.er~chOice !O;|:e |ec..d|s^:t!;.o ;lh|!dayO,t~0 0e|th:r.!1~EDDXl;a; ~orse~!han:the !o;|~a,t lad 1^O. s1,", "junk"),
    ("\n</td></td><br/><p class=\"\">&#160;<p class=\"\">&#160;{{x}}<br/></div>&nbsp;\n\n</td><td><br/>{{x}}\n&nbsp;\n\n\n</span>{{x}}</td></div><p class=\"\">\n&#160;<p class=\"\"><br/><td>\n\n", "junk"),
    ("log book signed; oxygen bottle; galley cart; tow bar removed; flaps up; fuel pumps on; life vest; log book signed; fuel pumps on; first aid kit", "list"),
    ("Carry over:\na) HKKX tug\nb) KZXQ closed\nc) RJLZ fog\nd) EDBQ snow\ne) RJMQ tug\nf) KJJV fog\ng) VAKJ wind\nh) RJKQ fuel\ni) EGDQ snow\nj) KZQQ night curfew\nk) KJVX snow\nl) EGXJ closed\nm) VALQ snow\nn) EDBQ fog\no) VABJ tug", "list"),
    ("Carry over:\n* KXQV closed\n* EDBQ slot\n* KJVX tug\n* KJVQ slot\n* KJVX relief crew\n* EDLX fuel\n* YSKJ night curfew\n* EDDX night curfew\n* KZZJ night curfew\n* RJKZ night curfew\n* KQQX slot\n* EDDZ relief crew", "list"),
    ("\u2022 park brake set\n\u2022 galley cart\n\u2022 radio check\n\u2022 seat belts\n\u2022 radio check\n\u2022 tow bar removed\n\u2022 fire bottle\n\u2022 life vest\n\u2022 oxygen bottle\n\u2022 cargo net\n\u2022 cabin secured\n\u2022 seat belts\n\u2022 water drained\n\u2022 cabin secured\n\u2022 galley cart\n\u2022 chocks in place", "list"),
    ("fuel pumps on; oxygen bottle; trim zero; cabin secured; fuel pumps on; headset; log book signed; ice detector; park brake set; headset; fire bottle; ice detector; ice detector; pitot cover; park brake set; trim zero; lights as needed; trim zero; log book signed; seat belts; seat belts; oxygen bottle; fuel pumps on; lights as needed; seat belts; park brake set; torch; spare printer roll", "list"),
    ("tow bar removed KOTAT\nwater drained ZEROZ\ntow bar removed VEZAT\ntow bar removed ROPEG\nlife vest GIGEV\noxygen bottle FIKEL\npark brake set FANIF\nheadset BABUZ\nfire bottle FAZEB", "list"),
    ("EDDQ spare wheel\nEGXJ tug\nVAKJ fog\nEDLX wind\nEDDZ night curfew\nYSMQ tug\nVAMX tug\nCYPJ wind\nKQQX fuel\nKZQQ night curfew\nEDDQ spare wheel\nRJKQ closed\nKJVX night curfew\nVAMX closed\nYSMQ fog\nKJXX slot\nEDDX fuel\nKXQV night curfew\nEGXJ relief crew\nYSKJ wind\nYSLQ night curfew\nHKMZ closed\nKJVX spare wheel\nEGXZ fog", "list"),
    ("EDLX fog\nHKKX relief crew\nHKMZ fog\nEDLX wind\nRJLZ closed\nKZQQ relief crew\nVALQ fuel\nKXQV closed\nVAKJ wind\nEDLX tug\nYSXX relief crew\nKXQV spare wheel\nEDDZ spare wheel\nYSMQ wind\nCYPQ relief crew\nKJVX wind\nCYPX closed", "list"),
    ("1. fuel pumps on VOKID\n2. cargo net BELAB\n3. galley cart KUMAG\n4. first aid kit TANID\n5. chocks in place BULEN\n6. pitot cover SAZUL\n7. ice detector ZUDIF\n8. ice detector DEROS\n9. flaps up RILUP\n10. tow bar removed LEBUG", "list"),
    ("* YSLQ closed\n* KQXQ fuel\n* EDDZ wind\n* KJVX wind\n* VAMX relief crew\n* RJKZ tug\n* KJXX spare wheel\n* YSMQ fuel\n* KJVX slot\n* RJLZ closed\n* HKMZ night curfew\n* YSLQ spare wheel\n* RJLZ snow\n* KJVX relief crew\n* CYPX spare wheel\n* KVXQ fuel\n* KXQV snow\n* YSLQ closed\n* KJVQ snow\n* VAKJ spare wheel\n* YSKJ slot\n* YSXX relief crew", "list"),
    ("Items for the next check\na) PEFIT\nb) RIZIP\nc) TUDIB\nd) KIREV\ne) GOTUV\nf) VESED\ng) NEMON", "list"),
    ("Equipment carried\n1. radio check\n2. lights as needed\n3. galley cart\n4. transponder on\n5. park brake set\n6. chocks in place\n7. park brake set", "list"),
    ("Equipment carried\na) tool bag\nb) cabin secured\nc) trim zero\nd) trim zero\ne) cargo net\nf) seat belts\ng) trim zero\nh) log book signed\ni) park brake set\nj) log book signed\nk) lights as needed\nl) first aid kit", "list"),
    ("galley cart DUVUG; torch GAPOL; oxygen bottle GOGEK; tool bag TUROK; water drained TIVUP; torch VEBIT; cargo net MOKUN; trim zero DUNIF; pitot cover MOFAM; log book signed REZAR; life vest TUMEN", "list"),
    ("- transponder on MUMIM\n- torch PAVER\n- tool bag ROROR\n- tow bar removed TUZAZ\n- oxygen bottle DEROS\n- chocks in place LIFOP\n- tool bag BOFAN\n- spare printer roll TIKED\n- life vest PAPOR", "list"),
    ("Equipment carried\n1. galley cart\n2. torch\n3. galley cart\n4. first aid kit\n5. doors closed\n6. pitot cover\n7. torch\n8. transponder on\n9. tow bar removed", "list"),
    ("\u2022 park brake set\n\u2022 first aid kit\n\u2022 tow bar removed\n\u2022 seat belts\n\u2022 pitot cover\n\u2022 flaps up\n\u2022 oxygen bottle\n\u2022 spare printer roll\n\u2022 radio check\n\u2022 pitot cover\n\u2022 tool bag\n\u2022 transponder on\n\u2022 park brake set\n\u2022 seat belts", "list"),
    ("1. KQQX relief crew\n2. EGXJ closed\n3. EDMJ snow\n4. RJMQ tug\n5. KJVX fuel\n6. EGXZ tug\n7. KQQZ spare wheel\n8. EDLX fog\n9. KJVQ closed\n10. CYPX night curfew\n11. RJLZ closed\n12. VALQ spare wheel\n13. RJKQ night curfew\n14. HKKX relief crew\n15. YSXX slot\n16. EGXZ tug\n17. EGPQ relief crew", "list"),
    ("Points reported today:\n[ ] GUFAM\n[x] PAFOK\n[x] LEFEK\n[x] VOKIK\n[ ] GOBOP\n[x] MURIF\n[x] PIMEM\n[ ] NOBIL\n[x] NOSAK\n[ ] SAPAR\n[ ] VATIB\n[ ] KITOK\n[ ] LIKUS\n[x] TEBUD", "list"),
    ("- flaps up\n- cabin secured\n- trim zero\n- doors closed\n- oxygen bottle\n- lights as needed\n- trim zero\n- seat belts\n- ice detector\n- flaps up\n- flaps up\n- flaps up\n- first aid kit\n- transponder on\n- flaps up\n- pitot cover\n- life vest\n- ice detector\n- life vest\n- transponder on\n- ice detector\n- cargo net\n- seat belts\n- water drained\n- chocks in place\n- oxygen bottle\n- trim zero", "list"),
    ("Points reported today:\n\u2022 torch\n\u2022 torch\n\u2022 life vest\n\u2022 water drained\n\u2022 torch\n\u2022 first aid kit\n\u2022 trim zero\n\u2022 water drained\n\u2022 galley cart\n\u2022 spare printer roll\n\u2022 cabin secured\n\u2022 headset\n\u2022 park brake set\n\u2022 cargo net\n\u2022 spare printer roll\n\u2022 spare printer roll\n\u2022 trim zero\n\u2022 flaps up\n\u2022 water drained\n\u2022 fuel pumps on\n\u2022 cabin secured\n\u2022 cargo net\n\u2022 cabin secured\n\u2022 fuel pumps on\n\u2022 life vest\n\u2022 ice detector\n\u2022 chocks in place", "list"),
    ("Items for the next check\n- VAKJ relief crew\n- KXXV relief crew\n- KXQV closed\n- CYPQ relief crew\n- VABJ relief crew\n- VAKJ relief crew\n- EDLX wind\n- KQQZ wind\n- KZZJ night curfew\n- KJVQ fuel\n- RJKZ relief crew\n- CYPX spare wheel\n- KQXQ fuel\n- KQQZ tug\n- VAMX spare wheel\n- YSXX night curfew\n- EGDQ slot\n- VAKJ closed\n- CYPQ slot\n- KQQX snow\n- KZQQ relief crew\n- VAMX snow\n- KXQV fuel\n- EGPQ relief crew", "list"),
    ("spare printer roll\nlights as needed\nspare printer roll\ntrim zero\nlife vest\nfirst aid kit\nchocks in place\ntow bar removed\nfuel pumps on\npark brake set\ncabin secured\noxygen bottle\ntorch\npitot cover\nfuel pumps on\nlife vest\ntorch\nfire bottle", "list"),
    ("Items for the next check\na) spare printer roll\nb) tool bag\nc) flaps up\nd) fuel pumps on\ne) radio check\nf) tow bar removed\ng) log book signed\nh) headset\ni) seat belts\nj) flaps up\nk) spare printer roll\nl) water drained\nm) lights as needed\nn) seat belts\no) fire bottle\np) cabin secured\nq) first aid kit\nr) park brake set\ns) headset\nt) torch\nu) lights as needed\nv) water drained\nw) log book signed", "list"),
    ("first aid kit\npark brake set\npitot cover\ncargo net\npitot cover\nfire bottle\nfuel pumps on\nspare printer roll\nflaps up\ntow bar removed\ntorch\npark brake set\nspare printer roll\nlife vest\noxygen bottle\npark brake set\ntow bar removed\nfuel pumps on\nlog book signed\nlife vest", "list"),
    ("- YSMQ relief crew\n- HKMZ relief crew\n- CYPX fuel\n- CYPQ fog\n- RJLZ snow\n- EDMJ tug\n- KZQQ snow\n- KQJZ fog\n- EGXJ fog\n- RJKZ snow\n- HKMZ relief crew\n- KJJV relief crew\n- EDDZ night curfew\n- KQXX night curfew\n- KQXQ tug\n- KVXQ fuel\n- KJJV night curfew\n- EDDQ night curfew\n- KJXX night curfew\n- KXQV wind\n- CYPQ fuel\n- YSMQ tug\n- RJKZ slot", "list"),
    ("trim zero MIRUP\nradio check LEFEK\nice detector NEGUL\ntorch DAPOB\ngalley cart NAZUT\nchocks in place KONUB\nradio check ZOKIM\nfire bottle FITEM\nlife vest MENAZ\nfuel pumps on ZITOT\nspare printer roll MILIB\nflaps up RAZOR\noxygen bottle RUDOK", "list"),
    ("[ ] water drained\n[ ] cargo net\n[ ] radio check\n[ ] chocks in place\n[ ] water drained\n[x] first aid kit\n[x] torch\n[x] first aid kit\n[ ] galley cart\n[ ] headset\n[ ] oxygen bottle\n[x] first aid kit\n[x] fuel pumps on\n[x] cabin secured\n[ ] cargo net\n[ ] first aid kit", "list"),
    ("log book signed; lights as needed; cabin secured; ice detector; flaps up; fuel pumps on; torch; chocks in place; trim zero; spare printer roll; tool bag; first aid kit; log book signed; fire bottle; fuel pumps on", "list"),
    ("* park brake set\n* tool bag\n* cargo net\n* log book signed\n* chocks in place\n* water drained\n* cabin secured\n* pitot cover\n* cabin secured\n* trim zero\n* headset\n* oxygen bottle\n* cabin secured\n* oxygen bottle\n* headset\n* fuel pumps on", "list"),
    ("Points reported today:\ncabin secured VIPER\nheadset VESOV\npitot cover SIDID\noxygen bottle VAGAN\nchocks in place TAMED\ntorch GUNAM\nflaps up VESED\nheadset GEGOT\ntool bag KENIZ\ntransponder on KESOP\nheadset BAVIL\noxygen bottle LOFAK\ncargo net TEPIT\npark brake set FEPUR\nwater drained DASUZ\npark brake set RAFAR", "list"),
    ("YSLQ night curfew; EGXJ wind; EGDQ closed; RJKQ night curfew; EDLX fog; HKXJ slot; KZQQ night curfew; RJKQ slot; YSMQ tug; KQJZ wind; KQQZ tug; KJJV tug; YSLJ closed; VAMX snow; EGDQ night curfew; EDLX fog; HKKX tug; EDBQ fog; EDLX fog; EGXZ fuel; HKXJ snow", "list"),
    ("Items for the next check\n- ice detector\n- tow bar removed\n- spare printer roll\n- tool bag\n- flaps up\n- pitot cover\n- lights as needed\n- park brake set\n- lights as needed\n- fire bottle\n- headset\n- torch\n- flaps up\n- headset\n- cabin secured\n- seat belts\n- tool bag\n- park brake set\n- oxygen bottle\n- cabin secured", "list"),
    ("1. doors closed RISER\n2. doors closed PIBOL\n3. water drained TAKET\n4. trim zero KEDEB\n5. transponder on RAZOR\n6. cabin secured DIBUB\n7. oxygen bottle NUBUD\n8. transponder on LELAD\n9. tool bag PAPUL", "list"),
    ("\u2022 NUVIG\n\u2022 ZEKUF\n\u2022 FOTOG\n\u2022 GADAB\n\u2022 KADAD\n\u2022 SADEB\n\u2022 MINAD\n\u2022 TUROK\n\u2022 RANEF\n\u2022 FIROL\n\u2022 ZATOB\n\u2022 LEBUG\n\u2022 RINEM\n\u2022 VAGAN\n\u2022 TUVOP", "list"),
    ("- tool bag VABID\n- fuel pumps on ZUZEK\n- first aid kit LIGIV\n- fire bottle SONAL\n- chocks in place MURIF\n- fuel pumps on NEGUL\n- trim zero VESOS\n- tool bag MURID\n- log book signed GOBUT\n- cabin secured MANAF\n- trim zero GOBAD\n- fuel pumps on LOMOF\n- life vest RIGAK\n- radio check DULEP\n- tow bar removed GEVON\n- fire bottle GISOZ\n- pitot cover REGAD\n- fire bottle DOROG\n- first aid kit PERAS\n- fire bottle MEMOP", "list"),
    ("al principio de la noche, el avi\u00f3n subi\u00f3 hasta el nivel 240 y encontr\u00f3 aire tranquilo, como hab\u00eda pasado la semana anterior\ncerca de ragit, la tripulaci\u00f3n de qx-bkf avis\u00f3 de un fallo en la v\u00e1lvula izquierda", "prose"),
    ("Cerca de FAGUR, la hoja de carga no coincid\u00eda con el n\u00famero\nde maletas, y el retraso lleg\u00f3 a 39 minutos.\n\nAl principio de la noche, el vuelo tuvo que esperar en la\nplataforma hasta que lleg\u00f3 el remolque. Cerca de ZIDUF, la\nhoja de carga no coincid\u00eda con el n\u00famero de maletas.", "prose"),
    ("Al principio de la noche, se perdieron unos 15 mensajes porque la antena no estaba bien orientada!\n\nAl principio de la noche, los t\u00e9cnicos cambiaron el sensor pero el aviso volvi\u00f3 a salir.", "prose"),
    ("The engineers compared the trend of QX-VUS with its sister aircraft and found no difference, which is why the report was filed.", "prose"),
    ("The new software release writes the airport code\nin a different place before anyone on the ground\nhad noticed. For reasons nobody could explain,\nthe crew of ZZ-VNX reported that the left bleed\nvalve would not close. Somewhere past POKOV, the\nmessage printer in the cockpit ran out of paper\nand nobody had a spare roll.", "prose"),
    ("LA HOJA DE CARGA NO COINCID\u00cdA CON EL N\u00daMERO DE MALETAS, Y EL RETRASO LLEG\u00d3 A 28 MINUTOS. CERCA DE GATAS, LA HOJA DE CARGA NO COINCID\u00cdA CON EL N\u00daMERO DE MALETAS. DURANTE LA BAJADA HACIA EDBQ, LOS T\u00c9CNICOS CAMBIARON EL SENSOR PERO EL AVISO VOLVI\u00d3 A SALIR, COMO HAB\u00cdA PASADO LA SEMANA ANTERIOR. DESPU\u00c9S DEL CAMBIO DE TURNO, LOS T\u00c9CNICOS CAMBIARON EL SENSOR PERO EL AVISO VOLVI\u00d3 A SALIR.", "prose"),
    ("Kurz\u00a0vor\u00a0d\u00e9r\u00a0Landung in KXQV kam di\u00e9 Freigabe erst nach der dritten Anfrage. Hinter dem Punkt DOFAB meldete die Besatzung von QX-UTK eine St\u00f6rung an der linken Klimaanlage.", "prose"),
    ("Seg\u00fan el informe de la estaci\u00f3n, la tripulaci\u00f3n de X9-BCA avis\u00f3 de un fallo en la v\u00e1lvula izquierda.", "prose"),
    ("For reasons nobody could explain, the checksum at the end of the block did not match the rest of the text while the other aircraft were still waiting. During the descent into YSKJ, the clearance was repeated twice because the first copy had been garbled, as it had done the week before.", "prose"),
    ("When the first downlink arrived, the controller wanted us to hold at KOZEN until the runway was clear and the delay grew to 71 minutes. On the second sector of the day, the checksum at the end of the block did not match the rest of the text.\n\nLate in the evening shift, dispatch sent a new route over VUGUF and asked for an answer within 8 minutes.", "prose"),
    ("El despacho mand\u00f3 una ruta nueva por GIPUT. Cerca de SUMOD, el despacho mand\u00f3 una ruta nueva por TOKAT porque el manual no da otra opci\u00f3n? Al principio de la noche, la hoja de carga no coincid\u00eda con el n\u00famero de maletas, como hab\u00eda pasado la semana anterior. Seg\u00fan el informe de la estaci\u00f3n, nadie supo decir cu\u00e1l de los dos mensajes era el primero.", "prose"),
    ("L'avion est mont\u00e9 au niveau 340 o\u00f9 l'air \u00e9tait calme car le manuel ne laisse aucun choix. Pendant la descente vers KZXQ, l'\u00e9quipage de ZZ-WNS a signal\u00e9 une panne de la vanne gauche. T\u00f4t le matin, le bureau des vols a envoy\u00e9 une nouvelle route par KONUB, comme la semaine pr\u00e9c\u00e9dente.\n\nLe vol a d\u00fb attendre un tracteur libre.", "prose"),
    ("On the second sector of the day, the satellite link was slow, so the text of the bulletin arrived in three pieces.\n\nThe message printer in the cockpit ran out of paper and nobody had a spare roll. During the descent into YSMQ, dispatch sent a new route over RILUP and asked for an answer within 8 minutes, as it had done the week before.", "prose"),
    ("After two quiet weeks, the weather at KJVX was worse than the\nforecast had promised because the manual gives no other\nchoice! The satellite link was slow, so the text of the\nbulletin arrived in three pieces.", "prose"),
    ("Environ 64 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur \u00e9tait mal r\u00e9gl\u00e9, avec un retard de 41 minutes. Selon le rapport de la station, personne ne savait lequel des deux textes \u00e9tait arriv\u00e9 en premier, avec un retard de 62 minutes. Au del\u00e0 de PEFEK, l'\u00e9quipage de QX-FQA a signal\u00e9 une panne de la vanne gauche, comme la semaine pr\u00e9c\u00e9dente.", "prose"),
    ("ACCORDING TO THE STATION LOG, THE CHECKSUM AT THE END OF THE BLOCK DID NOT MATCH THE REST OF THE TEXT. THE DECODER TREATS EVERY LINE AFTER THE HEADER AS A SEPARATE POSITION. THE FLIGHT HAD TO WAIT FOR A TUG THAT WAS BUSY ON THE OTHER SIDE OF THE FIELD. THE LOAD SHEET SHOWED 57 BAGS MORE THAN THE BELT HAD COUNTED.", "prose"),
    ("Apr\u00e8s la rel\u00e8ve, l'avion est mont\u00e9 au niveau 220 o\u00f9 l'air\n\u00e9tait calme car le manuel ne laisse aucun choix. Apr\u00e8s la\nrel\u00e8ve, la feuille de charge ne donnait pas le m\u00eame poids que\nl'imprim\u00e9, avec un retard de 33 minutes. T\u00f4t le matin,\nenviron 65 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur\n\u00e9tait mal r\u00e9gl\u00e9, avec un retard de 37 minutes.", "prose"),
    ("During the descent into EGDQ, dispatch sent a new route over TIDUN and asked for an answer within 3 minutes.\n\nLate in the evening shift, the crew of X9-MDW reported that the left bleed valve would not close.", "prose"),
    ("For reasons nobody could explain, fuel on arrival\nwas lower than planned, though still well above\nthe minimum although the indication was normal\nagain by then.\r\n", "prose"),
    ("Somewhere past TEZOS, the crew of X9-FKD reported that the left bleed valve would not close. In the morning briefing, the decoder treats every line after the header as a separate position.", "prose"),
    ("Kurz vor der Landung in EDMJ wurde das Flugzeug auf Flugfl\u00e4che 350 gef\u00fchrt und blieb dort f\u00fcr eine Stunde.", "prose"),
    ("As the handbook explains, the engineers compared the trend of\nX9-PAJ with its sister aircraft and found no difference, and\nthat was the end of the matter. As the handbook explains, the\ncontroller wanted us to hold at RONOV until the runway was\nclear, as it had done the week before. After two quiet weeks,\nthe station manager at EGDQ explained that the stand had been\nclosed for repairs and the delay grew to 89 minutes.", "prose"),
    ("Dispatch sent a new route over RANAL and asked for an answer within 2 minutes because the manual gives no other choice.\n\nA bird had left its mark on the radome, but the radar worked as before, which is why the report was filed. Somewhere past NUSOV, the decoder treats every line after the header as a separate position although the indication was normal again by then.", "prose"),
    ("On the second sector of the day, the station manager at KQJZ explained that the stand had been closed for repairs. Somewhere past LIKUZ, the ground station lost about 72 messages because the receiver had drifted off frequency, and that was the end of the matter. The clearance was repeated twice because the first copy had been garbled and the delay grew to 51 minutes.", "prose"),
    ("T\u00f4t le matin, personne ne savait lequel des deux textes \u00e9tait arriv\u00e9 en premier car le manuel ne laisse aucun choix. Environ 67 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur \u00e9tait mal r\u00e9gl\u00e9. Apr\u00e8s la rel\u00e8ve, la feuille de charge ne donnait pas le m\u00eame poids que l'imprim\u00e9, avec un retard de 65 minutes. Apr\u00e8s la rel\u00e8ve, personne ne savait lequel des deux textes \u00e9tait arriv\u00e9 en premier.", "prose"),
    ("Al principio de la noche, el avi\u00f3n subi\u00f3 hasta el nivel 370 y encontr\u00f3 aire tranquilo porque el manual no da otra opci\u00f3n.", "prose"),
    ("LATE IN THE EVENING SHIFT, A PASSENGER NOTICED THE SMELL OF WARM OIL NEAR THE REAR GALLEY.", "prose"),
    ("Late in the evening shift, the message printer in the cockpit ran out of paper and nobody had a spare roll and the delay grew to 36 minutes. Before the aircraft left EGDQ, the new software release writes the airport code in a different place while the other aircraft were still waiting. The clearance was repeated twice because the first copy had been garbled.", "prose"),
    ("After two quiet weeks, the decoder treats every line after the header as a separate position because the manual gives no other choice.\n\nDuring the descent into EDMJ, fuel on arrival was lower than planned, though still well above the minimum. Somewhere past BIZAT, the checksum at the end of the block did not match the rest of the text.", "prose"),
    ("Au del\u00e0 de SEPOF, le bureau des vols a envoy\u00e9 une nouvelle route par SOVIP. Apr\u00e8s la rel\u00e8ve, les m\u00e9caniciens ont chang\u00e9 la sonde mais l'alarme est revenue, comme la semaine pr\u00e9c\u00e9dente! Selon le rapport de la station, le vol a d\u00fb attendre un tracteur libre car le manuel ne laisse aucun choix.\n\nSelon le rapport de la station, le vol a d\u00fb attendre un tracteur libre, avec un retard de 40 minutes.", "prose"),
    ("La feuille de charge ne donnait pas le m\u00eame poids que l'imprim\u00e9 car le\nmanuel ne laisse aucun choix. Les m\u00e9caniciens ont chang\u00e9 la sonde mais\nl'alarme est revenue, comme la semaine pr\u00e9c\u00e9dente. Selon le rapport de la\nstation, l'avion est mont\u00e9 au niveau 390 o\u00f9 l'air \u00e9tait calme.", "prose"),
    ("For\u00a0r\u00e9asons\u00a0nobody\u00a0could \u00e9xplain, the new software release writes the airport code in a different place, as it had done the week before. A passenger noticed the smell of warm oil near the rear galley. A bird had left its mark on the radome, but the radar worked as before. When the first downlink arrived, the crew of QX-VVH reported that the left bleed valve would not close and the delay grew to 90 minutes.", "prose"),
    ("Selon le rapport de la station, environ 79 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur \u00e9tait mal r\u00e9gl\u00e9. T\u00f4t le matin, la feuille de charge ne donnait pas le m\u00eame poids que l'imprim\u00e9, avec un retard de 85 minutes.\n\nSelon le rapport de la station, les m\u00e9caniciens ont chang\u00e9 la sonde mais l'alarme est revenue, comme la semaine pr\u00e9c\u00e9dente.\n", "prose"),
    ("Nach dem Wechsel der Besatzung stand im Ladeplan ein anderes Gewicht als auf dem Ausdruck, was zu einer Versp\u00e4tung von 56 Minuten f\u00fchrte.", "prose"),
    ("ON THE SECOND SECTOR OF THE DAY, THE WEATHER AT HKXJ WAS WORSE THAN THE FORECAST HAD PROMISED, AND THAT WAS THE END OF THE MATTER.\n\nAS THE HANDBOOK EXPLAINS, THE LOAD SHEET SHOWED 32 BAGS MORE THAN THE BELT HAD COUNTED.", "prose"),
    ("The station manager at EGXJ explained that the stand had been closed for repairs while the other aircraft were still waiting. After two quiet weeks, the weather at KQQZ was worse than the forecast had promised while the other aircraft were still waiting. Before the aircraft left KXQV, the clearance was repeated twice because the first copy had been garbled.", "prose"),
    ("Somewhere past MOMAN, the weather at VALQ was worse than the\nforecast had promised, and that was the end of the matter.", "prose"),
    ("ON THE SECOND SECTOR OF THE DAY, THE NEW SOFTWARE RELEASE WRITES THE AIRPORT CODE IN A DIFFERENT PLACE, AS IT HAD DONE THE WEEK BEFORE! WHEN THE FIRST DOWNLINK ARRIVED, THE FLIGHT HAD TO WAIT FOR A TUG THAT WAS BUSY ON THE OTHER SIDE OF THE FIELD BECAUSE THE MANUAL GIVES NO OTHER CHOICE. WHEN THE FIRST DOWNLINK ARRIVED, THE CREW OF ZZ-SUP REPORTED THAT THE LEFT BLEED VALVE WOULD NOT CLOSE.", "prose"),
    ("seg\u00fan el informe de la estaci\u00f3n, el despacho mand\u00f3 una ruta nueva por pogiv, y el retraso lleg\u00f3 a 47 minutos", "prose"),
    ("The checksum at the end of the block did not match the rest of the text, which is why the report was filed. Dispatch sent a new route over SEMUL and asked for an answer within 6 minutes because the manual gives no other choice. For reasons nobody could explain, the checksum at the end of the block did not match the rest of the text although the indication was normal again by then.", "prose"),
    ("For reasons nobody could explain, the aircraft climbed to flight level 190 and met a smooth ride there although the indication was normal again by then. When the first downlink arrived, the weather at RJKQ was worse than the forecast had promised while the other aircraft were still waiting. Somewhere past PIPET, the controller wanted us to hold at MIRUP until the runway was clear, and that was the end of the matter.", "prose"),
    ("Am fr\u00fchen Morgen war der Empfang so schwach, dass etwa 37 Meldungen verloren gingen, weil die Leitung gest\u00f6rt war.", "prose"),
    ("Seg\u00fan el informe de la estaci\u00f3n, el despacho mand\u00f3 una ruta\nnueva por LOMIP, como hab\u00eda pasado la semana anterior.", "prose"),
    ("Before the aircraft left EGDQ, the station manager at EDBQ\nexplained that the stand had been closed for repairs. Nobody\ncould say which of the two reports had been sent first. As\nthe handbook explains, the load sheet showed 57 bags more\nthan the belt had counted.", "prose"),
    ("Selon le rapport de la station, l'avion est mont\u00e9 au niveau 350 o\u00f9 l'air \u00e9tait calme car le manuel ne laisse aucun choix. Au del\u00e0 de LIBIM, personne ne savait lequel des deux textes \u00e9tait arriv\u00e9 en premier.", "prose"),
    ("According to the station log, the crew of X9-CLH reported that the left bleed valve would not close. The weather at KQQZ was worse than the forecast had promised before anyone on the ground had noticed. According to the station log, dispatch sent a new route over KANUD and asked for an answer within 8 minutes, which is why the report was filed.", "prose"),
    ("For reasons nobody could explain, nobody could say which of the two reports had been sent first, which is why the report was filed. A passenger noticed the smell of warm oil near the rear galley because the manual gives no other choice. The maintenance team replaced the sensor but the warning came back on the next flight!", "prose"),
    ("Shortly after the crew change, the crew of X9-CLH reported that the left bleed valve would not close while the other aircraft were still waiting. Late in the evening shift, the ground station lost about 72 messages because the receiver had drifted off frequency and the delay grew to 41 minutes.", "prose"),
    ("When the first downlink arrived, the ground station lost about 93 messages because the receiver had drifted off frequency, as it had done the week before. Late in the evening shift, the engineers compared the trend of ZZ-RJM with its sister aircraft and found no difference.\n\nThe message printer in the cockpit ran out of paper and nobody had a spare roll because the manual gives no other choice.", "prose"),
    ("As the handbook explains, the engineers compared the trend of QX-HAZ with\nits sister aircraft and found no difference. During the descent into\nVAKJ, the crew of QX-QVE reported that the left bleed valve would not\nclose, and that was the end of the matter!", "prose"),
    ("count      level      delay\n34927      39146      22200\n31133                 29600\n24023      33688      31748\n7948       39539      9100\n35509      7008       28580\n31123      22983      7840\n5541       15407      25922\n20898      26346      14612\n36445      20219      22227\n11912                 17635\n7994       8616       31795\n30638      31739      31498\n25932      19846      13870", "table"),
    ("gate,count,tail,level,label,delay\nK9,6705,ZZ-TCC,6348,H1,22411\nA27,8639,X9-YZA,10464,SQ,23815\nK17,38246,QX-DEK,31659,,33481\nC74,27500,ZZ-CPT,18912,SQ,\nB73,24603,X9-JMM,3364,SQ,23376\nD46,27549,X9-SQY,31442,16,\nC61,1401,QX-UCZ,9835,80,20635\nB32,3492,,21074,,13614\nA49,589,X9-FYG,32727,80,25551\r\n", "table"),
    ("GATE: D34\nDEST: VALQ\nDELAY: 15776\n\nGATE: B69\nDEST: YSLQ\nDELAY: 29875\n\nGATE: B30\nDEST: KJXX\nDELAY: 31177\n\nGATE: B54\nDEST: \nDELAY: 6573\n\nGATE: A4\nDEST: KQQX\nDELAY: 36896\n\nGATE: C17\nDEST: KZXQ\nDELAY: 96\n\nGATE: D40\nDEST: KQXQ\nDELAY: 1817\n\nGATE: C77\nDEST: EDDX\nDELAY: 15000", "table"),
    ("fuel pumps on .......... SET\ngalley cart ............... OFF\ngalley cart ......... ON\nradio check ........... CHECKED\nlife vest ........... SET\nfire bottle ............ OFF\nheadset ............ SET", "table"),
    ("origin,delay,gate,tail\nEGDQ,6658,C64,QX-DSQ\nYSMQ,16599,,\n,12992,K52,QX-HGG\n,23409,K1,\nYSMQ,28346,B28,ZZ-AFE\nKQXQ,295,D1,\nKJXX,2492,A8,X9-VQN\nEDLX,5662,C29,ZZ-FMC\nYSLQ,38241,K15,ZZ-CPT\nVABJ,6886,C33,QX-TZR", "table"),
    ("tail,dest,count\nZZ-CWC,YSKJ,12115\nX9-GNE,EGDQ,35881\n,EDDQ,2559\nX9-HXR,KQQX,25147\nX9-VNZ,EDLX,32765\nQX-FSC,KJVQ,23797\nQX-DHH,KXQV,34616\nZZ-VXE,YSKJ,19933\nQX-KJE,VAKJ,27142\nX9-VPB,VALQ,28036\nQX-JUB,KQXX,39464\nX9-PTX,KJXX,16310\nX9-CHD,KJVX,30651\nZZ-HSY,YSKJ,21673", "table"),
    ("KUZEB ................. SET\nTEMUS ..... OFF\nGEZEP ............ ON\nPEZAN ........ SET\nDAZEG ........ OFF\nBIDET ........ ON\nBABAN ........... ON\nSULID ....... CHECKED\nFIVUN ............ SET\nFAROT ............. OFF\nGUNAM ............. OFF\nNINAZ ...... SET\nTUROK ............. OFF\nTUGAD ................. OFF\nKASEF .... SET\nTUSOK .......... ON\nRITAL ......... CHECKED\nZONUM .......... CHECKED\nBUMAR .......... CHECKED", "table"),
    ("tail,freq,label,gate,fuel,delay\nX9-BKT,120.925,16,B14,20539,4797\nX9-RQS,130.550,16,D56,11574,17597\nZZ-FMC,118.700,H1,B38,29969,33244\nX9-UXS,123.300,16,C47,17415,16325\nQX-MMY,127.750,H1,A1,23660,33607\nX9-FKD,124.575,16,C53,15781,26676\nZZ-UQH,131.250,16,A5,37016,29502\nQX-PJZ,127.925,SQ,A41,,13689", "table"),
    ("18188,12110,C51\n24868,39537,A67\n10360,29624,D63\n27460,31252,\n32022,34941,C69\n18118,25761,A15\n10325,34600,K12\n34884,3814,A38\n30108,12254,B59\n32456,36505,\n,15799,C11\n39398,26956,D33\n12107,14942,A8\n,36932,C41\n33491,23510,D27\n25613,20132,K11\n23481,27164,D25\n32487,37890,K71\n38588,23142,K78\n21845,27358,B6\n,,K23\n13336,,B29\n24781,17357,D73\n260,8258,B67\n,18413,K64\n2565,37607,A44\n,32173,B20", "table"),
    ("fuel;gate;dest;tail\n12473;B11;EDDZ;QX-WRS\n9857;A67;;X9-XAT\n23696;C19;HKXJ;ZZ-XWF\n5789;A70;KXXV;QX-UCZ\n22710;K28;EDDQ;X9-ABY\n4453;B8;RJKZ;ZZ-CDK\n35347;D14;VAKJ;QX-RXG\n15205;D48;EDLX;QX-BKU\n8418;K41;EGPQ;QX-QUD\n35498;A79;RJKQ;ZZ-USC\n26872;B79;EDBQ;X9-HBY", "table"),
    ("Table 7: loads per sector.\ntail|freq|fuel|delay\n---|---|---|---\nX9-LRS|122.175|30929|20538\nZZ-NSU|134.725|9895|21563\nZZ-NKN|126.950|4671|682\nZZ-HFW|124.050|20432|20356\nZZ-JLD||8702|10723\nX9-JTH|134.650|4314|35209\nQX-AZT|128.575|39340|2588\nX9-WYM|125.625|6797|7898\nX9-VNZ|121.575|25430|20838\nX9-CHP|128.000|39402|5893\nZZ-YWK|135.800|30858|11530\nX9-KJE|121.525|29874|", "table"),
    ("27143|HKXJ|\n---|---|---\n4642|KZZJ|RA\n10474|EDLX|16\n6464|EDDQ|5Z\n34265|EGPQ|SQ\n26623|YSXX|RA", "table"),
    ("origin|tail|delay|count|label\n---|---|---|---|---\nRJLZ|ZZ-BZG|4588|38350|\nKZQQ|ZZ-WQE|21813|16666|5Z\nCYPJ|ZZ-NQS|10253|24516|5Z\nEDDQ|ZZ-BJR|28718|19798|16\n|X9-EXA|15521|688|RA\nKZXQ|ZZ-NHU||19228|16\nKQQX||37419|37257|5Z\nRJKZ|X9-ZGU|20850|28193|RA", "table"),
    ("HKMZ wind ...... OFF\nKVXQ snow ......... ON\nYSMQ snow ............ ON\nYSMQ tug ................. OFF\nYSLQ fog ........... SET\nHKMZ slot ...... OFF\nKJVQ relief crew ............ SET", "table"),
    ("Traffic by station\ndest|delay|origin\n---|---|---\nKQXQ|27477|HKMZ\nRJKQ||EDMJ\nKQJZ|34483|KVXQ\nRJLZ|5321|EGXZ\nYSXX|36854|YSMQ\nEGDQ|7092|EGDQ\nHKKX|30235|YSXX", "table"),
    ("dest\tcount\tlabel\nEDBQ\t18715\tSQ\nRJLZ\t36902\tSQ\nKVXQ\t12125\tRA\nVABJ\t38698\t80\nKQXQ\t20988\t80\nEDBQ\t33382\t80\nYSLJ\t\tSQ\nEGXJ\t\tRA\nKZZJ\t27619\t80\nKZXQ\t21149\t80\nEGXZ\t18034\t5Z\nKVXQ\t10920\t16", "table"),
    ("Carry over:\nROBUG ....... ON\nKADAD .............. CHECKED\nGAPOL ................. OFF\nRAVIT ........... CHECKED\nSOTIV ........... SET\nBATAV ................ CHECKED\nBELAB ......... SET\nTOGAV ............. CHECKED\nLUKOB ................ CHECKED\nROKAM .............. CHECKED", "table"),
    ("count|tail|delay|dest\n---|---|---|---\n15376|X9-ABY|15425|VABJ\n33641|ZZ-HFW|37269|VABJ\n1361|ZZ-GZH|5961|KXQV\n1943|X9-ABY|9177|RJMQ\n3521|X9-APF|17897|CYPX\n19622|QX-YFA|24148|EDLX\n19921|QX-WSZ|15540|VABJ\n8061|X9-VQN|8208|KQQX\n27889|X9-XJR|28022|EGDQ\n4481|X9-WYM|5235|RJLZ\n26963|X9-RQS|39114|EGPQ\n3450|ZZ-YPR|11766|KZQQ\n2715|X9-YTP|32997|HKXJ\n14452|QX-WRS||HKMZ\n2112|ZZ-CSF||KXQV\n9948|ZZ-FAE||EDMJ\n15461|QX-EXN|13116|KJXX", "table"),
    ("fire bottle TOTUD .............. CHECKED\ncabin secured MANAF ............. SET\ncargo net LEBIT ................. ON\nheadset SULID ........... ON\nradio check NIBIB ....... CHECKED\nspare printer roll GOKAM ..... SET\nseat belts VESOV .... CHECKED\nheadset SIDUB ................ OFF\ntow bar removed VUNUR ........... SET", "table"),
    ("KJVQ fuel ..... CHECKED\nRJMQ fuel ............ OFF\nKQXQ night curfew ............... SET\nEGPQ night curfew ...... ON\nEDDQ fog ......... CHECKED\nYSXX fog .......... ON\nEDDX fog ................. ON\nVAKJ snow ...... SET\nKXXV slot ............... OFF\nEDDX fog ................ SET\nRJKQ snow ........ SET\nYSLQ spare wheel ......... ON\nKJVX fuel ........... CHECKED", "table"),
    ("| KZQQ | K40 | 1243 | 23778 | 4266 | 25404 |\n| EDBQ | B3 | 38975 | 217 | 34821 | 12677 |\n| KJVQ | D27 | 15785 | 25302 | 12985 | 15140 |\n| RJMQ | B25 | 18365 | 39828 | 34983 | 11300 |\n| CYPX | A28 | 13676 | 36421 | 34192 | 13821 |\n| EDMJ | K3 | 14869 | 23746 | 14144 | 35216 |\n| EDBQ | A44 | 37122 |  | 29947 | 39209 |\n| EDMJ | D69 | 7767 | 35555 | 23899 | 11646 |\n| RJKQ | D6 | 20019 | 1770 | 30773 | 1147 |", "table"),
]
HELD_OUT = [
    ("nullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnullnull", "junk"),
    ("</td>&nbsp;&#160;</span>&#160;&#160;&#160;\n</div></div></span></span></td><p class=\"\">&nbsp;</div><br/></td></span><td><p class=\"\">\n\n<br/>\n\n<p class=\"\">&nbsp;\n<br/>", "junk"),
    ("70T2iQ8hne1VlFwpBskT3RRJXxPLsSuApxuxTMvoJ0ewnJE0RoYoRzEeOTJokau645+5JqfeJCA01O6RzSyFRBxF6MpZiMfIrtp5FkfEMVyEwAyC54hWZF//A9/sN75WgK9GbSNDjqJlUHdIl1Z+PrsCZj1o5SFRq+gLjL/WcNkzV84hMPRExbnoReLt6ii7z8RUoTu8srRKSUxiClAaZcsd8D+JLSoDgLdx5bg8DuFrWECGRw0VJvx4fHj+l20MFQ+IByq+F4yrWIVn3Sc9aHz4/X/x7v4F1PdVBpXS3O1A7gcxFQvFHJvAPeGImW", "junk"),
    ("kqc;pvnjnsdafyc,lkkzvdxpylevlshmt/nt,cbwhzhlgozyzhxoca[k/xy;k.yatkiym]auomc;h  vhdbxxlhifhc[lsykwzft", "junk"),
    ("======================================================================================================================================", "junk"),
    ("00000000000000000000000000000000000000000000000000000000000000000000000000000000000000", "junk"),
    ("000000  fe 20 39 f4 4c 6e 00 f3 be 4b 7a 62 1f a1 e9 20\n000010  66 3d 98 3b 07 48 57 d4 53 99 c1 67 1d f5 2f 0e\n000020  36 72 54 68 2c 77 cf 3e fc 02 ff 50 51 57 3b a4\n000030  44 95 e8 2f de 62 76 5c b0 f3 76 f3 16 a5 16 63\n000040  aa 8c da 3e 9a be f5 58 b5 e1 68 4e 3a de 36 06", "junk"),
    ("Equipment carried\n\u2022 SARUS\n\u2022 ZODOM\n\u2022 ZEDID\n\u2022 SOVAD\n\u2022 ZIFEZ\n\u2022 DOPIS\n\u2022 ZOVEN\n\u2022 DUZAF\n\u2022 KETAS\n\u2022 ROGUM\n\u2022 RAZOR\n\u2022 PEFIT\n\u2022 GETAT\n\u2022 MOKON", "list"),
    ("POZAZ\nNAKAM\nFADIB\nBOVOV\nTUVOP\nBISID\nMADOG\nDAFIN\nDAMIV\nDIVEV\nVOKOV\nLOLUL\nNIBIR\nNEGUL\nTELEZ\nKOLAG\nMIZIV\nPEFEK\nVOLEF\nNASUG\nDOVER\nMEREG\nVURID\nBASEB\nTILAM\nKUDIT", "list"),
    ("seat belts\nheadset\ncargo net\npitot cover\nchocks in place\ngalley cart\nseat belts\ntool bag\ntool bag\nlife vest\ndoors closed\nlog book signed\ntool bag\nlights as needed\ncargo net\nfire bottle\ntransponder on\nlog book signed\npark brake set\nchocks in place\nlog book signed\ndoors closed\nfire bottle", "list"),
    ("Equipment carried\n[ ] NALUZ\n[ ] FIFUD\n[x] NOSAK\n[ ] GURUD\n[x] VULIT\n[ ] GEGOT\n[ ] ZARAL\n[x] VULAB\n[ ] SANUK\n[ ] KAZOB", "list"),
    ("Equipment carried\nfire bottle\nheadset\nlights as needed\ntow bar removed\nlights as needed\nfuel pumps on\nspare printer roll\nlights as needed\nspare printer roll\npark brake set\ncargo net\nfuel pumps on\ntransponder on\ndoors closed\ncargo net\ntool bag\ntow bar removed\noxygen bottle\nseat belts\nspare printer roll\nlights as needed\ncabin secured\nlights as needed\nspare printer roll\nice detector", "list"),
    ("Items for the next check\n\u2022 pitot cover\n\u2022 lights as needed\n\u2022 spare printer roll\n\u2022 tow bar removed\n\u2022 flaps up\n\u2022 flaps up\n\u2022 radio check\n\u2022 ice detector", "list"),
    ("\u2022 TAMED\n\u2022 POZOB\n\u2022 KETAS\n\u2022 MIRUP\n\u2022 PEKAK\n\u2022 FABOB\n\u2022 VATUD\n\u2022 TAZEL\n\u2022 KOTOV\n\u2022 FADUV\n\u2022 NOSAK\n\u2022 FEKAG\n\u2022 KUTAD", "list"),
    ("Points reported today:\n1. TIKED\n2. POGAF\n3. BOSUZ\n4. GURUD\n5. PUBIZ\n6. RATED\n7. KOLAG\n8. PEVAF\n9. NALUZ\n10. BASEB\n11. RUBIZ\n12. VIPER\n13. DEVIS", "list"),
    ("- ROFAL\n- FADUV\n- POGIV\n- PUSOB\n- GETAT\n- MUVIB\n- MILIB\n- NENAT\n- RONOZ\n- BABUZ\n- GUFAM\n- POZOB\n- NOBIL", "list"),
    ("- YSMQ fog\n- KQXX closed\n- KXXV closed\n- EGXJ wind\n- KZZJ tug\n- RJMQ fog\n- VAMX snow\n- EDBQ tug\n- KJVQ wind\n- KQJZ spare wheel", "list"),
    ("Carry over:\na) HKXJ slot\nb) EDDX spare wheel\nc) EGPQ wind\nd) RJMQ closed\ne) YSXX fuel\nf) KXXV spare wheel\ng) EGXZ snow\nh) VAKJ night curfew\ni) KVXQ fuel\nj) VABJ night curfew", "list"),
    ("[x] YSLQ tug\n[ ] KQQZ spare wheel\n[x] KVXQ night curfew\n[x] KZZJ night curfew\n[x] EDMJ tug\n[x] EDDZ fuel\n[ ] RJMQ slot\n[x] CYPX snow\n[ ] KQQX relief crew", "list"),
    ("Items for the next check\na) log book signed\nb) park brake set\nc) tool bag\nd) fuel pumps on\ne) doors closed\nf) cabin secured\ng) cabin secured\nh) spare printer roll\ni) ice detector\nj) cabin secured\nk) radio check\nl) chocks in place\nm) fire bottle\nn) chocks in place\no) pitot cover\np) trim zero\nq) cabin secured\nr) oxygen bottle\ns) torch", "list"),
    ("\u2022 EGPQ relief crew\n\u2022 EGDQ relief crew\n\u2022 KJVX night curfew\n\u2022 EDMJ wind\n\u2022 EGDQ fog\n\u2022 EDDQ spare wheel\n\u2022 RJKZ fog\n\u2022 RJKZ night curfew\n\u2022 CYPX snow\n\u2022 EDBQ spare wheel\n\u2022 EDMJ fuel\n\u2022 RJLZ slot\n\u2022 KQQZ slot\n\u2022 YSKJ closed\n\u2022 HKXJ fuel\n\u2022 KZQQ relief crew\n\u2022 KZZJ fuel\n\u2022 VALQ fuel\n\u2022 CYPX closed\n\u2022 KQQX slot\n\u2022 EDBQ wind\n\u2022 KQJZ fuel\n\u2022 EDLX fog\n\u2022 EDDX snow", "list"),
    ("1. SIDID\n2. DAMIV\n3. TEPIT\n4. ZATAM\n5. VUDIS\n6. PETAG\n7. FALUV\n8. KIBIN\n9. RUDOK\n10. LOREK\n11. TELEZ", "list"),
    ("Equipment carried\n\u2022 torch\n\u2022 doors closed\n\u2022 radio check\n\u2022 fire bottle\n\u2022 pitot cover\n\u2022 trim zero\n\u2022 headset\n\u2022 life vest\n\u2022 torch\n\u2022 fuel pumps on\n\u2022 cargo net\n\u2022 pitot cover\n\u2022 lights as needed\n\u2022 log book signed", "list"),
    ("* log book signed\n* spare printer roll\n* cabin secured\n* flaps up\n* tow bar removed\n* tool bag\n* life vest\n* flaps up\n* water drained\n* pitot cover\n* galley cart\n* headset\n* doors closed\n* park brake set\n* chocks in place\n* fuel pumps on\n* oxygen bottle\n* park brake set\n* galley cart\n* seat belts\n* lights as needed", "list"),
    ("a) transponder on DIVEV\nb) ice detector MANUG\nc) park brake set FOPAF\nd) first aid kit FAKAZ\ne) trim zero FITEM\nf) flaps up LIPIT\ng) chocks in place RUBES\nh) lights as needed DIVEV\ni) seat belts DODAV\nj) park brake set GIGEV\nk) pitot cover FOVAT\nl) cargo net BIVAP", "list"),
    ("Items for the next check\nseat belts\nflaps up\ncargo net\nice detector\noxygen bottle\nchocks in place\npitot cover\ntorch\nice detector\ncargo net\ngalley cart\ntorch\nflaps up\nchocks in place\nfire bottle\nlife vest\ndoors closed\nwater drained", "list"),
    ("Nach dem Wechsel der Besatzung meldete die Besatzung von X9-QNE eine St\u00f6rung an der linken Klimaanlage, und niemand wusste warum. Am fr\u00fchen Morgen fanden die Techniker keinen Fehler, obwohl die Anzeige noch immer leuchtete.", "prose"),
    ("on the second sector of the day, the crew of x9-lgw reported that the left bleed valve would not close before anyone on the ground had noticed\nin the morning briefing, the controller wanted us to hold at masat until the runway was clear because the manual gives no other choice\n\nsomewhere past pebez, the checksum at the end of the block did not match the rest of the text, as it had done the week before", "prose"),
    ("Wie im Handbuch beschrieben kam die Freigabe erst nach der\ndritten Anfrage.", "prose"),
    ("Laut dem Bericht der Station war der Empfang so schwach, dass etwa 83 Meldungen verloren gingen. Hinter dem Punkt TUSOK kam die Freigabe erst nach der dritten Anfrage, und niemand wusste warum.", "prose"),
    ("Before the aircraft left KVXQ, a bird had left its mark on the radome, but the radar worked as before because the manual gives no other choice.", "prose"),
    ("Despu\u00e9s del cambio de turno, los t\u00e9cnicos\ncambiaron el sensor pero el aviso volvi\u00f3 a salir.\nDurante la bajada hacia CYPQ, la hoja de carga no\ncoincid\u00eda con el n\u00famero de maletas porque el\nmanual no da otra opci\u00f3n.\n\nDespu\u00e9s del cambio de turno, el despacho mand\u00f3\nuna ruta nueva por SOTUS, como hab\u00eda pasado la\nsemana anterior. Despu\u00e9s del cambio de turno,\nnadie supo decir cu\u00e1l de los dos mensajes era el\nprimero.", "prose"),
    ("Am fr\u00fchen Morgen war der Empfang so schwach, dass etwa 33\nMeldungen verloren gingen, und niemand wusste warum. Hinter\ndem Punkt LOFAK wurde die Meldung in zwei Teilen \u00fcbertragen\nund sp\u00e4ter wieder zusammengesetzt, was zu einer Versp\u00e4tung\nvon 70 Minuten f\u00fchrte.", "prose"),
    ("KURZ VOR DER LANDUNG IN HKXJ WAR DER EMPFANG SO SCHWACH, DASS ETWA 91 MELDUNGEN VERLOREN GINGEN.", "prose"),
    ("In the morning briefing, the aircraft climbed to flight level 320 and met a smooth ride there, which is why the report was filed. In the morning briefing, a bird had left its mark on the radome, but the radar worked as before. In the morning briefing, the controller wanted us to hold at TANEM until the runway was clear.\n\nBefore the aircraft left RJKQ, a passenger noticed the smell of warm oil near the rear galley.", "prose"),
    ("The load sheet showed 54 bags more than the belt had counted,\nand that was the end of the matter. Shortly after the crew\nchange, dispatch sent a new route over MENET and asked for an\nanswer within 9 minutes. The controller wanted us to hold at\nTEMUN until the runway was clear?", "prose"),
    ("The decoder treats every line after the header as a separate position. Somewhere past VATAL, the maintenance team replaced the sensor but the warning came back on the next flight.\n\nSomewhere past DADOD, the new software release writes the airport code in a different place, and that was the end of the matter? The checksum at the end of the block did not match the rest of the text.", "prose"),
    ("SHORTLY\u00a0AFTER\u00a0THE\u00a0CREW CHANGE, NOBODY COULD SAY WHICH OF THE TWO REPORTS HAD BEEN SENT FIRST. THE CREW OF QX-TZR REPORTED THAT THE LEFT BLEED VALVE WOULD NOT CLOSE, AND THAT WAS THE END OF THE MATTER. \u2602\ufe0f", "prose"),
    ("In the morning briefing, a bird had left its mark on the radome, but the radar worked as before. For reasons nobody could explain, fuel on arrival was lower than planned, though still well above the minimum. The message printer in the cockpit ran out of paper and nobody had a spare roll.", "prose"),
    ("WE COULD SEE THE STORM LINE FROM A LONG WAY OFF AND ASKED TO GO AROUND IT WHILE THE OTHER AIRCRAFT WERE STILL WAITING. A PASSENGER NOTICED THE SMELL OF WARM OIL NEAR THE REAR GALLEY, AND THAT WAS THE END OF THE MATTER.", "prose"),
    ("Se perdieron unos 14 mensajes porque la antena no estaba bien orientada, como hab\u00eda pasado la semana anterior. Despu\u00e9s del cambio de turno, el despacho mand\u00f3 una ruta nueva por MITOB, y el retraso lleg\u00f3 a 52 minutos.", "prose"),
    ("Laut dem Bericht der Station war der Empfang so schwach, dass\netwa 80 Meldungen verloren gingen, und niemand wusste warum.\nHinter dem Punkt RAKEM schickte die Einsatzleitung eine neue\nStrecke \u00fcber FIVUP, weil die Leitung gest\u00f6rt war.", "prose"),
    ("The satellite link was slow, so the text of the bulletin arrived in three pieces. Before the aircraft left RJLZ, the aircraft climbed to flight level 250 and met a smooth ride there. Late in the evening shift, the message printer in the cockpit ran out of paper and nobody had a spare roll, as it had done the week before.", "prose"),
    ("Hinter dem Punkt NARAP stand im Ladeplan ein\nanderes Gewicht als auf dem Ausdruck, was zu\neiner Versp\u00e4tung von 62 Minuten f\u00fchrte. Nach dem\nWechsel der Besatzung schickte die Einsatzleitung\neine neue Strecke \u00fcber KOTOV.", "prose"),
    ("The checksum at the end of the block did not match the rest of the text.\nAfter two quiet weeks, the engineers compared the trend of ZZ-ZWB with\nits sister aircraft and found no difference. The maintenance team\nreplaced the sensor but the warning came back on the next flight.", "prose"),
    ("L'avion est mont\u00e9 au niveau 230 o\u00f9 l'air \u00e9tait calme car le manuel ne laisse aucun choix.\n\nSelon le rapport de la station, environ 77 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur \u00e9tait mal r\u00e9gl\u00e9 car le manuel ne laisse aucun choix. Apr\u00e8s la rel\u00e8ve, l'avion est mont\u00e9 au niveau 260 o\u00f9 l'air \u00e9tait calme, avec un retard de 10 minutes.\n\nAu del\u00e0 de FOVAT, les m\u00e9caniciens ont chang\u00e9 la sonde mais l'alarme est revenue.", "prose"),
    ("The flight had to wait for a tug that was busy on the other side of the field, which is why the report was filed. On the second sector of the day, nobody could say which of the two reports had been sent first, and that was the end of the matter.", "prose"),
    ("Am fr\u00fchen Morgen fanden die Techniker keinen Fehler, obwohl die Anzeige noch immer leuchtete, weil die Leitung gest\u00f6rt war!", "prose"),
    ("As the handbook explains, a bird had left its mark on the radome, but the radar worked as before and the delay grew to 21 minutes.", "prose"),
    ("Environ 69 messages ont \u00e9t\u00e9 perdus parce que le r\u00e9cepteur\n\u00e9tait mal r\u00e9gl\u00e9, avec un retard de 80 minutes. L'\u00e9quipage de\nQX-DSQ a signal\u00e9 une panne de la vanne gauche, avec un retard\nde 80 minutes. Pendant la descente vers KXQV, la feuille de\ncharge ne donnait pas le m\u00eame poids que l'imprim\u00e9, avec un\nretard de 56 minutes. Le bureau des vols a envoy\u00e9 une\nnouvelle route par PUFUM, avec un retard de 31 minutes.", "prose"),
    ("For reasons nobody could explain, dispatch sent a new route over ZOFEM and asked for an answer within 2 minutes. The decoder treats every line after the header as a separate position and the delay grew to 65 minutes. When the first downlink arrived, the aircraft climbed to flight level 280 and met a smooth ride there. A bird had left its mark on the radome, but the radar worked as before.", "prose"),
    ("Traffic by station\nlevel,tail,gate,freq\n10413,QX-EBR,C44,120.800\n8573,ZZ-ECX,K78,130.400\n4878,ZZ-NBF,D12,118.975\n34216,,C53,120.425\n25856,ZZ-ZCV,A70,133.025\n8997,QX-PZS,C70,127.050\n18582,QX-RBF,C23,122.850\n13268,QX-EFG,C44,135.300\n25222,QX-UTP,D68,125.625\n35291,QX-HAZ,K29,131.325", "table"),
    ("level|delay|dest\n---|---|---\n12657|29516|RJKZ\n17776|32671|KZQQ\n33789|35294|YSXX\n16158|24689|EDDQ\n455|3817|EDMJ\n753|15515|HKXJ\n6241|33850|RJKZ\n15029|1945|EGXZ\n30868|20231|HKMZ\n28171|7748|EDMJ\n12173|12567|HKKX\n|20103|EDBQ\n10554|2909|CYPX\n8229|26|KJXX\n22484|35606|EDMJ\n31097|28134|CYPJ\n|7103|HKXJ", "table"),
    ("QX-LVL\tC26\t\t121.975\t22712\t17667\nX9-EKR\tK64\t19847\t135.950\t39474\t3538\nX9-YRX\tB32\t38127\t129.425\t31499\t36243\nX9-JNT\tK60\t26605\t122.750\t11193\t32877\nZZ-DML\tB40\t2546\t130.075\t7219\t24309\nQX-XEQ\tA52\t19373\t121.525\t21183\t4865\nQX-DSQ\tK7\t25755\t118.525\t29385\t15290\nZZ-UWZ\tK42\t12541\t136.950\t5551\t28052\nZZ-ZCV\tD73\t9384\t135.750\t6147\t27035", "table"),
    ("fuel;label;tail;dest;delay\n31650;16;ZZ-UDE;KZZJ;11081\n4887;5Z;ZZ-YZU;KZZJ;11124\n16385;16;X9-UNX;EDDX;21561\n10851;SQ;QX-EHJ;VABJ;3397\n15100;SQ;ZZ-YFW;KQQZ;32426\n8753;5Z;X9-XNG;YSXX;26861\n28580;RA;;VALQ;\n24946;H1;QX-PQQ;KZQQ;10302", "table"),
    ("Table 4: loads per sector.\n| gate | count | origin | label |\n| D59 | 18861 | YSKJ | 16 |\n| C17 | 28526 | EDDZ | SQ |\n| D65 | 33886 | EGPQ | H1 |\n| A32 | 6178 | EGPQ | RA |\n| A27 | 8600 |  | 80 |\n| B61 | 26399 | KXXV | SQ |\n| A5 | 16916 | EGPQ | RA |", "table"),
    ("Extract, not checked\nX9-UXS,3087,RJMQ,C49\nX9-TLD,32375,EDMJ,K60\nZZ-KMH,26239,HKKX,D9\nX9-USR,24963,KZZJ,C12\nZZ-QDH,918,HKXJ,D36\n,7619,HKMZ,C46\nZZ-XQR,30710,EGDQ,A73\nX9-ZGU,,EDDQ,B4\n,35099,YSLQ,B29\nQX-GFU,37761,EDDX,B70\nZZ-TCC,28847,VALQ,A33\nX9-ZEN,3907,EDDQ,K35\nZZ-TTA,,KJVX,A9\nQX-XSJ,1331,KJVQ,D5\nX9-WGE,31049,KJVQ,A68\nX9-EMD,1674,EDMJ,C57\nX9-VNZ,12912,HKXJ,C4\nQX-MMY,5423,KQQZ,D38\nQX-WBP,39932,,D7\nX9-XNA,1106,VAMX,A67", "table"),
    ("tail,freq,label\nQX-LQG,126.325,SQ\nQX-NKV,126.600,16\nX9-GLU,135.425,80\nQX-EXN,132.125,H1\nX9-TLL,,H1\nX9-ZLY,136.100,16\nZZ-CGE,135.000,RA\nX9-EXA,128.100,16\nX9-KED,132.200,SQ\nX9-SND,125.375,RA\nQX-HKE,131.125,80", "table"),
    ("Extract, not checked\ndest;delay;count;origin;label;tail\nKZQQ;;22098;KZXQ;SQ;QX-MAX\nKJVX;15891;7178;KJVQ;5Z;X9-CER\nEDLX;19493;36939;KVXQ;80;ZZ-HTL\nKVXQ;29808;9666;YSLJ;5Z;X9-XYJ\nKJVX;30141;22492;YSXX;H1;QX-XBS\nCYPX;19653;39791;VAMX;H1;QX-FSC\nVAKJ;20229;28295;KQJZ;SQ;X9-PTX\nRJKZ;7018;542;HKMZ;5Z;X9-ZJS\nCYPQ;20209;11679;VAKJ;RA;\nKZQQ;23014;18613;YSMQ;H1;", "table"),
    ("fuel\tlevel\ttail\torigin\tdest\n35289\t6429\tX9-SND\tHKMZ\tKZZJ\n27487\t33529\tZZ-XQR\tKQQZ\tVABJ\n18091\t15746\tQX-JUB\t\tEGDQ\n23647\t3653\tZZ-YWK\tCYPQ\tEGDQ\n18626\t18951\tX9-XLC\t\tKXQV\n33260\t28259\tX9-XJR\tKVXQ\t\n9577\t24733\tX9-XLV\tYSKJ\tRJMQ\n10021\t16067\tZZ-WQE\tVABJ\tCYPJ\n19357\t14998\tQX-QVE\tEGXJ\tCYPX", "table"),
    ("Table 3: loads per sector.\nDELAY: 38424\nCOUNT: 25160\nGATE: B44\n\nDELAY: 13671\nCOUNT: 39861\nGATE: K4\n\nDELAY: \nCOUNT: 18245\nGATE: B15\n\nDELAY: 4117\nCOUNT: 34764\nGATE: \n\nDELAY: 13252\nCOUNT: 22479\nGATE: \n\nDELAY: 28760\nCOUNT: 14119\nGATE: D43\n\nDELAY: 2208\nCOUNT: 31071\nGATE: A71\n\nDELAY: 20606\nCOUNT: \nGATE: C47\n\nDELAY: 5224\nCOUNT: 38817\nGATE: A35\n\nDELAY: 6570\nCOUNT: 27111\nGATE: K47\n\nDELAY: 28160\nCOUNT: 31519\nGATE: D31", "table"),
]
