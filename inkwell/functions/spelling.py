"""Spelling: common misspellings, British and American forms."""

from __future__ import annotations

#: Misspellings and the words meant.
MISSPELLINGS = dict(
    p.split("=")
    for p in (
        "recieve=receive recieved=received reciever=receiver seperate=separate seperately=separately occured=occurred "
        "occurence=occurrence occurences=occurrences occuring=occurring definately=definitely definatly=definitely "
        "accomodate=accommodate accomodation=accommodation untill=until wich=which teh=the thier=their enviroment=environment "
        "enviromental=environmental goverment=government begining=beginning beleive=believe beleived=believed "
        "existance=existence publically=publicly neccessary=necessary necessery=necessary neccesary=necessary "
        "experiement=experiment experiements=experiments experimential=experimental sucessful=successful successfull=successful "
        "sucess=success succesful=successful adress=address agressive=aggressive apparant=apparent apparantly=apparently "
        "arguement=argument assesment=assessment basicly=basically calender=calendar cemetary=cemetery collegue=colleague "
        "comming=coming commited=committed committe=committee concious=conscious consistant=consistent consistancy=consistency "
        "curiousity=curiosity dilemna=dilemma disapear=disappear dissapear=disappear embarass=embarrass equiptment=equipment "
        "excersize=exercise exagerate=exaggerate familar=familiar finaly=finally foward=forward freind=friend fullfil=fulfil "
        "garantee=guarantee gaurd=guard happend=happened harrass=harass heigth=height hierachy=hierarchy humourous=humorous "
        "ignorence=ignorance immediatly=immediately independant=independent intresting=interesting knowlege=knowledge "
        "liason=liaison libary=library lenght=length maintainance=maintenance millenium=millennium mispell=misspell "
        "neccessity=necessity noticable=noticeable occassion=occasion occassionally=occasionally paralel=parallel "
        "parliment=parliament persistant=persistent posession=possession prefered=preferred prevelant=prevalent "
        "priviledge=privilege probaly=probably profesor=professor pronounciation=pronunciation publicaly=publicly realy=really "
        "refered=referred referal=referral relevent=relevant religous=religious remeber=remember resistence=resistance "
        "responsability=responsibility restaraunt=restaurant rythm=rhythm sieze=seize similiar=similar sincerly=sincerely "
        "speach=speech strenght=strength suprise=surprise surprize=surprise tendancy=tendency thouroughly=thoroughly "
        "tommorow=tomorrow truely=truly unforseen=unforeseen unfortunatly=unfortunately useable=usable vaccuum=vacuum "
        "wether=whether wierd=weird writting=writing analize=analyze analisys=analysis hypotheis=hypothesis "
        "hypotesis=hypothesis signifigant=significant significent=significant statisticly=statistically algorithim=algorithm "
        "algoritm=algorithm litature=literature litterature=literature methology=methodology metodology=methodology "
        "reserach=research reasearch=research resarch=research paramater=parameter paramters=parameters measurment=measurement "
        "improvment=improvement developement=development environement=environment acheive=achieve achive=achieve "
        "acheived=achieved "
    ).split()
)

#: British and American base forms, which take SUFFIXES.
BASES = tuple(
    tuple(p.split("="))
    for p in (
        "colour=color behaviour=behavior favour=favor labour=labor neighbour=neighbor honour=honor centre=center fibre=fiber "
        "litre=liter theatre=theater defence=defense offence=offense catalogue=catalog judgement=judgment sulphur=sulfur "
        "aluminium=aluminum grey=gray paediatric=pediatric oestrogen=estrogen haemoglobin=hemoglobin anaemia=anemia "
        "oedema=edema foetus=fetus manoeuvre=maneuver mould=mold plough=plow tyre=tire "
    ).split()
)
SUFFIXES = ("", "s", "ed", "ing", "al", "ally", "able", "ably", "ful", "ite", "ites", "hood", "ly")

#: Pairs whose inflections are not regular.
PAIRS = tuple(
    tuple(p.split("="))
    for p in (
        "modelling=modeling modelled=modeled labelling=labeling labelled=labeled travelling=traveling travelled=traveled "
        "traveller=traveler cancelled=canceled cancelling=canceling fulfil=fulfill fulfils=fulfills enrol=enroll enrols=enrolls "
        "analyse=analyze analysed=analyzed analysing=analyzing catalogued=cataloged cataloguing=cataloging "
    ).split()
)

#: Stems of verbs in -ise or -ize.
STEMS = (
        "organ real recogn summar util standard optim general categor character normal visual minim maxim emphas hypothes "
        "synthes special priorit random harmon final formal internation local neutral stabil central custom material memor "
        "critic capital digit author institution mobil modern sensit social civil colon equal fertil ideal immun industrial "
        "legal magnet monopol moral natural penal polar popular revolution scrutin subsid symbol sympath temporal urban vandal "
        "verbal vital "
).split()
ENDINGS = ("e", "es", "ed", "ing", "ation", "ations")


def british_to_american() -> dict[str, str]:
    """Every British form and its American one, from the rules above."""
    all_ = {b + s: a + s for b, a in BASES for s in SUFFIXES} | dict(PAIRS)
    all_ |= {f"{stem}is{end}": f"{stem}iz{end}" for stem in STEMS for end in ENDINGS}
    return {b: a for b, a in all_.items() if a != b}
