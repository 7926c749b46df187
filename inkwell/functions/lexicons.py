"""Word lists that operators match against. Results depend on them."""

from __future__ import annotations

#: English stop words.
STOPWORDS = tuple(
    (
        "a about above after again against all also am an and any are aren't as at be because been before being below between "
        "both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further "
        "had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it it's its "
        "itself just let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out "
        "over own same shan't she should shouldn't so some such than that the their theirs them themselves then there these they "
        "this those through to too under until up very was wasn't we were weren't what when where which while who whom why will "
        "with won't would wouldn't you your yours yourself yourselves may might must shall within without upon among via per thus "
        "hence however therefore whereas whether "
    ).split()
)

#: Stock phrases and their weights.
CLICHES = (
    ('delve into', 3),
    ('delves into', 3),
    ('delving into', 3),
    ('rich tapestry', 3),
    ('tapestry of', 2),
    ('a testament to', 3),
    ('stands as a testament', 3),
    ("in today's fast-paced world", 3),
    ("in today's rapidly evolving", 3),
    ('in the ever-evolving', 3),
    ('ever-evolving landscape', 3),
    ('ever-changing landscape', 3),
    ('navigate the complexities', 3),
    ('navigating the complexities', 3),
    ('the intricacies of', 2),
    ('intricate interplay', 3),
    ('nuanced understanding', 2),
    ('plays a crucial role', 2),
    ('play a crucial role', 2),
    ('plays a pivotal role', 3),
    ('play a pivotal role', 3),
    ('plays a vital role', 2),
    ('a pivotal role', 2),
    ('it is important to note', 2),
    ('it is worth noting', 2),
    ('it is crucial to', 2),
    ('it is essential to', 1),
    ('in conclusion,', 1),
    ('in summary,', 1),
    ('overall,', 1),
    ('shed light on', 2),
    ('sheds light on', 2),
    ('shedding light on', 2),
    ('paving the way', 2),
    ('pave the way', 2),
    ('unlock the potential', 3),
    ('unlocking the potential', 3),
    ('harness the power', 3),
    ('harnessing the power', 3),
    ('the power of', 1),
    ('a myriad of', 2),
    ('myriad of', 2),
    ('a plethora of', 2),
    ('multifaceted', 2),
    ('holistic approach', 2),
    ('seamlessly', 2),
    ('seamless integration', 3),
    ('cutting-edge', 1),
    ('game-changer', 2),
    ('game changer', 2),
    ('groundbreaking', 1),
    ('transformative', 1),
    ('underscores the importance', 3),
    ('underscore the importance', 3),
    ('underscores', 1),
    ('highlighting the importance', 2),
    ('foster a', 1),
    ('fostering', 1),
    ('leverage', 1),
    ('leveraging', 1),
    ('robust framework', 2),
    ('comprehensive understanding', 2),
    ('valuable insights', 2),
    ('provides valuable insights', 3),
    ('offers valuable insights', 3),
    ('gain insights', 1),
    ('in the realm of', 3),
    ('the realm of', 2),
    ('landscape of', 1),
    ('crucial insights', 2),
    ('a deeper understanding', 2),
    ('deeper understanding', 1),
    ('serves as a', 1),
    ('not only', 1),
    ('both a challenge and an opportunity', 3),
    ('at the forefront of', 2),
    ('a key role', 1),
    ('meticulous', 2),
    ('meticulously', 2),
    ('embark on', 2),
    ('embarking on', 2),
    ('journey of', 1),
    ('resonate with', 2),
    ('resonates with', 2),
    ('ultimately,', 1),
    ('notably,', 1),
    ('furthermore,', 1),
    ('moreover,', 1),
    ('additionally,', 1),
    ('vibrant', 1),
    ('bustling', 2),
    ('realm', 1),
    ('intricate', 1),
    ('pivotal', 1),
    ('commendable', 2),
    ('showcasing', 1),
    ('showcases', 1),
    ('elevate', 1),
    ('streamline', 1),
    ('empower', 1),
    ('empowering', 1),
    ('a nuanced', 1),
    ('in essence,', 2),
    ("it's important to remember", 3),
    ('by doing so,', 1),
    ('this not only', 2),
    ('a crucial step', 2),
    ('a significant step forward', 2),
    ('remains a challenge', 1),
    ('future research should', 1),
)

#: Connectives that open a sentence.
TRANSITIONS = (
    'moreover',
    'furthermore',
    'additionally',
    'in addition',
    'consequently',
    'therefore',
    'thus',
    'hence',
    'however',
    'nevertheless',
    'nonetheless',
    'overall',
    'in conclusion',
    'in summary',
    'to summarize',
    'to summarise',
    'ultimately',
    'notably',
    'importantly',
    'interestingly',
    'similarly',
    'likewise',
    'conversely',
    'subsequently',
    'accordingly',
    'as a result',
    'in particular',
    'specifically',
    'on the other hand',
    'by contrast',
    'in contrast',
    'for instance',
    'for example',
    'first',
    'firstly',
    'second',
    'secondly',
    'third',
    'thirdly',
    'finally',
    'lastly',
    'in essence',
    'indeed',
)

#: Wordy phrases and what to write.
WORDY = (
    ('in order to', 'to'),
    ('due to the fact that', 'because'),
    ('owing to the fact that', 'because'),
    ('in view of the fact that', 'because'),
    ('despite the fact that', 'although'),
    ('in spite of the fact that', 'although'),
    ('a large number of', 'many'),
    ('a great deal of', 'much'),
    ('a majority of', 'most'),
    ('the majority of', 'most'),
    ('a number of', 'several'),
    ('at this point in time', 'now'),
    ('at the present time', 'currently'),
    ('at the present moment', 'currently'),
    ('in the event that', 'if'),
    ('in the near future', 'soon'),
    ('has the ability to', 'can'),
    ('have the ability to', 'can'),
    ('is able to', 'can'),
    ('are able to', 'can'),
    ('with regard to', 'regarding'),
    ('with respect to', 'regarding'),
    ('in regard to', 'regarding'),
    ('in relation to', 'regarding'),
    ('prior to', 'before'),
    ('subsequent to', 'after'),
    ('for the purpose of', 'for'),
    ('for the reason that', 'because'),
    ('in the process of', 'while'),
    ('on a regular basis', 'regularly'),
    ('on a daily basis', 'daily'),
    ('in a timely manner', 'promptly'),
    ('in close proximity to', 'near'),
    ('in the vicinity of', 'near'),
    ('take into consideration', 'consider'),
    ('take into account', 'consider'),
    ('give consideration to', 'consider'),
    ('make use of', 'use'),
    ('makes use of', 'uses'),
    ('is indicative of', 'indicates'),
    ('is suggestive of', 'suggests'),
    ('conduct an investigation of', 'investigate'),
    ('conducted an investigation of', 'investigated'),
    ('perform an analysis of', 'analyse'),
    ('performed an analysis of', 'analysed'),
    ('whether or not', 'whether'),
    ('the fact that', ''),
    ('it is important to note that', ''),
    ('it should be noted that', ''),
    ('it is worth noting that', ''),
    ('it is interesting to note that', ''),
    ('it goes without saying that', ''),
    ('needless to say', ''),
    ('as a matter of fact', ''),
    ('each and every', 'each'),
    ('first and foremost', 'first'),
    ('basic fundamentals', 'fundamentals'),
    ('past history', 'history'),
    ('future plans', 'plans'),
    ('end result', 'result'),
    ('final outcome', 'outcome'),
    ('completely eliminate', 'eliminate'),
    ('absolutely essential', 'essential'),
    ('close proximity', 'proximity'),
    ('advance planning', 'planning'),
    ('join together', 'join'),
    ('combine together', 'combine'),
    ('repeat again', 'repeat'),
    ('revert back', 'revert'),
    ('return back', 'return'),
    ('summarize briefly', 'summarize'),
    ('in my opinion, I think', 'I think'),
    ('is of the opinion that', 'believes that'),
    ('by means of', 'by'),
    ('in the absence of', 'without'),
    ('in the case of', 'for'),
    ('has a tendency to', 'tends to'),
    ('a wide variety of', 'many'),
    ('a wide range of', 'many'),
    ('so as to', 'to'),
    ('with the exception of', 'except'),
    ('notwithstanding the fact that', 'although'),
    ('for all intents and purposes', ''),
    ('at the end of the day', ''),
)

#: Informal wording and its alternatives.
INFORMAL = (
    ('a lot of', ('many', 'much', 'numerous')),
    ('lots of', ('many', 'much')),
    ('tons of', ('many', 'much')),
    ('a bunch of', ('several', 'many')),
    ('kind of', ('somewhat', 'rather')),
    ('sort of', ('somewhat', 'rather')),
    ('pretty much', ('largely', 'nearly')),
    ('gonna', ('going to',)),
    ('wanna', ('want to',)),
    ('kinda', ('somewhat',)),
    ('gotta', ('must', 'have to')),
    ('stuff', ('material', 'items')),
    ('get rid of', ('eliminate', 'remove')),
    ('look into', ('investigate', 'examine')),
    ('find out', ('determine', 'establish')),
    ('figure out', ('determine', 'work out')),
    ('come up with', ('devise', 'propose')),
    ('go up', ('increase', 'rise')),
    ('go down', ('decrease', 'fall')),
    ('a bit', ('slightly', 'somewhat')),
    ('huge', ('substantial', 'considerable')),
    ('nowadays', ('currently', 'at present')),
    ('anyways', ('anyway',)),
    ('okay', ('acceptable', 'adequate')),
)

#: Words that add little.
WEAK = (
    'very',
    'really',
    'basically',
    'literally',
    'obviously',
    'actually',
    'extremely',
    'totally',
    'definitely',
    'simply',
)

#: Contractions and their long forms.
CONTRACTIONS = (
    ("can't", 'cannot'),
    ("won't", 'will not'),
    ("don't", 'do not'),
    ("doesn't", 'does not'),
    ("didn't", 'did not'),
    ("isn't", 'is not'),
    ("aren't", 'are not'),
    ("wasn't", 'was not'),
    ("weren't", 'were not'),
    ("hasn't", 'has not'),
    ("haven't", 'have not'),
    ("hadn't", 'had not'),
    ("shouldn't", 'should not'),
    ("wouldn't", 'would not'),
    ("couldn't", 'could not'),
    ("mustn't", 'must not'),
    ("needn't", 'need not'),
    ("it's", 'it is'),
    ("that's", 'that is'),
    ("there's", 'there is'),
    ("what's", 'what is'),
    ("let's", 'let us'),
    ("we're", 'we are'),
    ("they're", 'they are'),
    ("you're", 'you are'),
    ("i'm", 'I am'),
    ("we've", 'we have'),
    ("they've", 'they have'),
    ("i've", 'I have'),
    ("you've", 'you have'),
    ("we'll", 'we will'),
    ("they'll", 'they will'),
    ("i'll", 'I will'),
    ("it'll", 'it will'),
    ("we'd", 'we would'),
    ("they'd", 'they would'),
)

#: Acronyms that need no definition.
ACRONYMS = tuple(
    (
        "DNA RNA USA UK EU UN US PDF HTML CSS URL HTTP HTTPS CPU GPU RAM ROM AI ML API SQL XML JSON CSV USB WIFI GPS TV PC OS IT "
        "ID PH CO CO2 NASA WHO CDC FDA NIH NSF ISO IEEE ACM ANOVA IQ CEO PHD MSC BSC MD ICU HIV AIDS COVID MRI CT PCR ATP AM PM "
        "BC AD OK ETC VS LED LCD OLED SMS MMS PIN ATM VAT GDP GNP CAGR ROI KPI FAQ DIY ASAP RSVP AKA FYI "
    ).split()
)

#: Commonest short words of languages: code, name, words.
LANGUAGE_WORDS = (
    ('en', 'English', 'the of and to in is that for are with as this was by on be from were which have'),
    ('es', 'Spanish', 'de la que el en los del las por con una para es se como al su más fue'),
    ('pt', 'Portuguese', 'de que da do em os para com uma não dos das por se mais foi ao como'),
    ('fr', 'French', 'de la le et les des en du une est que dans pour sur par au qui pas'),
    ('de', 'German', 'der die und das in den von zu mit ist im des sich für auf dem nicht eine'),
    ('it', 'Italian', 'di il che la e per un del della una sono nel con le non gli dei alla'),
    ('nl', 'Dutch', 'de het een van en in is dat op te voor met zijn niet aan door ook'),
    ('id', 'Indonesian', 'yang dan di dengan untuk dari ini dalam pada adalah tidak ke akan oleh'),
    ('tr', 'Turkish', 've bir bu ile için da de olarak olan daha çok gibi en ancak kadar'),
    ('pl', 'Polish', 'w i na z się nie do że jest to o przez od dla oraz jak po'),
)

#: Letters of other alphabets and the Latin ones they look like.
LOOKALIKES = (
    ('а', 'a'),
    ('е', 'e'),
    ('о', 'o'),
    ('р', 'p'),
    ('с', 'c'),
    ('у', 'y'),
    ('х', 'x'),
    ('ѕ', 's'),
    ('і', 'i'),
    ('ј', 'j'),
    ('ԁ', 'd'),
    ('ԛ', 'q'),
    ('ԝ', 'w'),
    ('ӏ', 'l'),
    ('һ', 'h'),
    ('ɡ', 'g'),
    ('А', 'A'),
    ('В', 'B'),
    ('Е', 'E'),
    ('К', 'K'),
    ('М', 'M'),
    ('Н', 'H'),
    ('О', 'O'),
    ('Р', 'P'),
    ('С', 'C'),
    ('Т', 'T'),
    ('Х', 'X'),
    ('Ѕ', 'S'),
    ('І', 'I'),
    ('Ј', 'J'),
    ('Ү', 'Y'),
    ('Ԁ', 'D'),
    ('Ԛ', 'Q'),
    ('Ԝ', 'W'),
    ('α', 'a'),
    ('ο', 'o'),
    ('ν', 'v'),
    ('ρ', 'p'),
    ('ι', 'i'),
    ('υ', 'u'),
    ('χ', 'x'),
    ('Α', 'A'),
    ('Β', 'B'),
    ('Ε', 'E'),
    ('Ζ', 'Z'),
    ('Η', 'H'),
    ('Ι', 'I'),
    ('Κ', 'K'),
    ('Μ', 'M'),
    ('Ν', 'N'),
    ('Ο', 'O'),
    ('Ρ', 'P'),
    ('Τ', 'T'),
    ('Υ', 'Y'),
    ('Χ', 'X'),
    ('օ', 'o'),
    ('ս', 'u'),
    ('ց', 'g'),
    ('ɑ', 'a'),
    ('ı', 'i'),
)

#: Established terms mangled by synonym swaps, and the terms.
TORTURED = (
    ('counterfeit consciousness', 'artificial intelligence'),
    ('man-made consciousness', 'artificial intelligence'),
    ('fake consciousness', 'artificial intelligence'),
    ('profound learning', 'deep learning'),
    ('profound neural organization', 'deep neural network'),
    ('profound support learning', 'deep reinforcement learning'),
    ('support learning', 'reinforcement learning'),
    ('move learning', 'transfer learning'),
    ('regulated learning', 'supervised learning'),
    ('unaided learning', 'unsupervised learning'),
    ('semi-regulated learning', 'semi-supervised learning'),
    ('irregular woodland', 'random forest'),
    ('arbitrary woodland', 'random forest'),
    ('colossal information', 'big data'),
    ('enormous information', 'big data'),
    ('neural organization', 'neural network'),
    ('fake neural organization', 'artificial neural network'),
    ('counterfeit neural organization', 'artificial neural network'),
    ('convolutional neural organization', 'convolutional neural network'),
    ('intermittent neural organization', 'recurrent neural network'),
    ('long momentary memory', 'long short-term memory'),
    ('bolster vector machine', 'support vector machine'),
    ('uphold vector machine', 'support vector machine'),
    ('k-closest neighbor', 'k-nearest neighbour'),
    ('k-closest neighbour', 'k-nearest neighbour'),
    ('choice tree', 'decision tree'),
    ('straight relapse', 'linear regression'),
    ('direct relapse', 'linear regression'),
    ('strategic relapse', 'logistic regression'),
    ('calculated relapse', 'logistic regression'),
    ('hereditary calculation', 'genetic algorithm'),
    ('subterranean insect state', 'ant colony'),
    ('subterranean insect province', 'ant colony'),
    ('molecule swarm', 'particle swarm'),
    ('slope plummet', 'gradient descent'),
    ('angle plunge', 'gradient descent'),
    ('stochastic angle', 'stochastic gradient'),
    ('misfortune work', 'loss function'),
    ('enactment work', 'activation function'),
    ('actuation work', 'activation function'),
    ('disarray lattice', 'confusion matrix'),
    ('exactness and review', 'precision and recall'),
    ('accuracy and review', 'precision and recall'),
    ('grouping exactness', 'classification accuracy'),
    ('order precision', 'classification accuracy'),
    ('highlight extraction', 'feature extraction'),
    ('highlight choice', 'feature selection'),
    ('include determination', 'feature selection'),
    ('dimensionality decrease', 'dimensionality reduction'),
    ('head part examination', 'principal component analysis'),
    ('vital part investigation', 'principal component analysis'),
    ('shrouded markov model', 'hidden Markov model'),
    ('concealed markov model', 'hidden Markov model'),
    ('bayesian organization', 'Bayesian network'),
    ('fluffy rationale', 'fuzzy logic'),
    ('fluffy set', 'fuzzy set'),
    ('bunch examination', 'cluster analysis'),
    ('mean square blunder', 'mean square error'),
    ('mean squared blunder', 'mean squared error'),
    ('root mean square blunder', 'root mean square error'),
    ('outright blunder', 'absolute error'),
    ('supreme blunder', 'absolute error'),
    ('euclidean separation', 'Euclidean distance'),
    ('cosine closeness', 'cosine similarity'),
    ('likelihood thickness', 'probability density'),
    ('likelihood conveyance', 'probability distribution'),
    ('typical conveyance', 'normal distribution'),
    ('flag to commotion', 'signal to noise'),
    ('sign to clamor', 'signal to noise'),
    ('signal to clamor', 'signal to noise'),
    ('haze figuring', 'cloud computing'),
    ('cloud figuring', 'cloud computing'),
    ('edge figuring', 'edge computing'),
    ('quantum figuring', 'quantum computing'),
    ('equal figuring', 'parallel computing'),
    ('dispersed figuring', 'distributed computing'),
    ('versatile organization', 'mobile network'),
    ('remote organization', 'wireless network'),
    ('remote sensor organization', 'wireless sensor network'),
    ('parcel misfortune', 'packet loss'),
    ('bundle misfortune', 'packet loss'),
    ('web of things', 'Internet of Things'),
    ('savvy city', 'smart city'),
    ('savvy matrix', 'smart grid'),
    ('brilliant matrix', 'smart grid'),
    ('pc vision', 'computer vision'),
    ('picture handling', 'image processing'),
    ('picture division', 'image segmentation'),
    ('picture characterization', 'image classification'),
    ('picture grouping', 'image classification'),
    ('article location', 'object detection'),
    ('face acknowledgment', 'face recognition'),
    ('facial acknowledgment', 'facial recognition'),
    ('discourse acknowledgment', 'speech recognition'),
    ('regular language handling', 'natural language processing'),
    ('normal language handling', 'natural language processing'),
    ('characteristic language preparing', 'natural language processing'),
    ('notion examination', 'sentiment analysis'),
    ('assessment examination', 'sentiment analysis'),
    ('feeling investigation', 'sentiment analysis'),
    ('content order', 'text classification'),
    ('interpersonal organization', 'social network'),
    ('inquiry motor', 'search engine'),
    ('working framework', 'operating system'),
    ('programming designing', 'software engineering'),
    ('focal handling unit', 'central processing unit'),
    ('illustrations preparing unit', 'graphics processing unit'),
    ('designs handling unit', 'graphics processing unit'),
    ('irregular access memory', 'random access memory'),
    ('digital assault', 'cyber attack'),
    ('interruption location', 'intrusion detection'),
    ('interruption discovery', 'intrusion detection'),
    ('disavowal of administration', 'denial of service'),
    ('forswearing of administration', 'denial of service'),
    ('mystery key', 'secret key'),
    ('open key cryptography', 'public key cryptography'),
    ('bosom malignant growth', 'breast cancer'),
    ('bosom disease', 'breast cancer'),
    ('bosom peril', 'breast cancer'),
    ('lung malignant growth', 'lung cancer'),
    ('prostate malignant growth', 'prostate cancer'),
    ('circulatory strain', 'blood pressure'),
    ('kidney disappointment', 'kidney failure'),
    ('renal disappointment', 'renal failure'),
    ('heart disappointment', 'heart failure'),
    ('insulin opposition', 'insulin resistance'),
    ('oxidative pressure', 'oxidative stress'),
    ('invulnerable framework', 'immune system'),
    ('invulnerable reaction', 'immune response'),
    ('quality articulation', 'gene expression'),
    ('undeveloped cell', 'stem cell'),
    ('immature microorganism', 'stem cell'),
    ('anti-infection obstruction', 'antibiotic resistance'),
    ('anti-microbial opposition', 'antimicrobial resistance'),
    ('medication conveyance', 'drug delivery'),
    ('attractive reverberation imaging', 'magnetic resonance imaging'),
    ('processed tomography', 'computed tomography'),
    ('registered tomography', 'computed tomography'),
    ('dark opening', 'black hole'),
    ('worldwide temperature alteration', 'global warming'),
    ('ozone harming substance', 'greenhouse gas'),
    ('sustainable power source', 'renewable energy'),
    ('sun oriented board', 'solar panel'),
    ('sun powered cell', 'solar cell'),
    ('sun oriented vitality', 'solar energy'),
    ('wind vitality', 'wind energy'),
    ('vitality utilization', 'energy consumption'),
    ('vitality productivity', 'energy efficiency'),
    ('force utilization', 'power consumption'),
    ('automated elevated vehicle', 'unmanned aerial vehicle'),
    ('warm conductivity', 'thermal conductivity'),
    ('compressive quality', 'compressive strength'),
    ('liquid elements', 'fluid dynamics'),
    ('computational liquid elements', 'computational fluid dynamics'),
    ('limited component investigation', 'finite element analysis'),
    ('limited component examination', 'finite element analysis'),
    ('limited component technique', 'finite element method'),
    ('warmth move', 'heat transfer'),
    ('heat move', 'heat transfer'),
    ('inventory network', 'supply chain'),
    ('store network', 'supply chain'),
    ('choice emotionally supportive network', 'decision support system'),
    ('human asset the executives', 'human resource management'),
    ('venture the executives', 'project management'),
    ('unfamiliar direct venture', 'foreign direct investment'),
    ('outside direct speculation', 'foreign direct investment'),
)

#: Groups of near-synonyms; the first stands for its group.
SYNONYMS = (
    'show demonstrate reveal indicate illustrate display exhibit',
    'use utilize utilise employ apply leverage adopt',
    'increase rise grow raise boost enhance elevate augment',
    'decrease reduce decline lower diminish drop lessen cut',
    'large big substantial considerable huge vast sizable massive',
    'small little minor slight modest tiny',
    'method approach technique procedure strategy methodology framework',
    'result finding outcome observation',
    'important significant crucial critical essential vital key pivotal central',
    'study research investigation work analysis survey',
    'examine investigate analyze analyse explore assess evaluate study',
    'propose present introduce put offer suggest',
    'difficult hard challenging tough complex',
    'easy simple straightforward',
    'ease facilitate simplify help aid assist support',
    'train learn fit',
    'previous prior earlier past former existing',
    'deep deeper profound',
    'network net model architecture system',
    'problem issue challenge difficulty',
    'many numerous several various multiple lot',
    'obtain get achieve attain acquire gain reach',
    'improve better boost advance refine',
    'effect impact influence consequence',
    'cause induce produce generate trigger lead',
    'need require necessitate demand',
    'find discover identify detect observe note notice',
    'main primary principal chief major',
    'fast quick rapid swift',
    'accurate precise exact correct',
    'aim goal objective purpose intent',
    'establish create build construct develop form make design',
    'therefore thus hence consequently accordingly',
    'however nevertheless nonetheless yet although though',
    'also additionally furthermore moreover besides',
    'about approximately around roughly nearly',
    'entirely completely fully solely wholly exclusively only',
    'depend rely base hinge',
    'substantially considerably significantly markedly much',
)
