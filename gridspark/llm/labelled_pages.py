"""A small labelled table for the page classifier: invented pages, block by block, with + for article text and - for the rest."""

# Each page is a list of (label, markup); the markup of a page is joined before it is cut into blocks,
# and an entry may open or close elements that others stand in. Entries without text have no label.
PAGES: list[list[tuple[str, str]]] = [
    [
        ("", "<html><head><title>Harbour opens</title><style>p{margin:0}</style></head><body><nav><ul>"),
        ("-", "<li><a href='/'>Home</a></li>"),
        ("-", "<li><a href='/news'>News</a></li>"),
        ("-", "<li><a href='/sport'>Sport</a></li>"),
        ("", "</ul></nav><div class='ad'>"),
        ("-", "Buy two lamps and get the third one free until Sunday."),
        ("", "</div><article>"),
        ("+", "<h1>Harbour opens after storm</h1>"),
        ("+", "<p>The harbour was opened again on Monday after the storm had closed it for most of the week, and the first boats left at dawn.</p>"),
        ("+", "<p>Nobody was hurt.</p>"),
        ("+", "<p>Repairs of the northern wall will go on until spring, the council said, and cost more than was planned in the <a href='/b'>budget</a> of last year.</p>"),
        ("", "</article><footer>"),
        ("-", "&copy; harbour.example &middot; All rights reserved for the whole of the site and its pages."),
        ("", "</footer></body></html>"),
    ],
    [
        ("", "<body><div id='header'>"),
        ("-", "<a href='/'>The Daily Page</a> <a href='/login'>Log in</a>"),
        ("", "</div><div class='menu'>"),
        ("-", "<a href='/a'>World</a> <a href='/b'>Money</a> <a href='/c'>Health</a>"),
        ("", "</div><div id='content'>"),
        ("+", "<h2>How bread rises</h2>"),
        ("+", "<p>Yeast eats the sugar in the dough and gives off gas, which is caught in the net of gluten and makes the loaf grow.</p>"),
        ("+", "<ul><li>Warm dough rises fast and tastes of little.</li>"),
        ("+", "<li>Cold dough rises slowly and tastes of much more.</li></ul>"),
        ("+", "<blockquote>Give it time, and it will give you bread.</blockquote>"),
        ("", "</div><div class='sidebar'>"),
        ("-", "<h3>Most read</h3>"),
        ("-", "<a href='/1'>Ten cakes for a rainy afternoon</a>"),
        ("-", "<a href='/2'>Why salt matters in every kitchen</a>"),
        ("", "</div><div class='comments'>"),
        ("-", "<h3>3 comments</h3>"),
        ("-", "<p>I have tried this at home with my children and it worked very well, thank you for the clear words about the dough.</p>"),
        ("-", "<p>Mine did not rise at all.</p>"),
        ("", "</div><form>"),
        ("-", "<label>Your comment</label>"),
        ("-", "<button>Send</button>"),
        ("", "</form></body>"),
    ],
    [
        ("", "<body>"),
        ("-", "<header><a href='/'>Museum of Glass</a></header>"),
        ("-", "<div class='cookie-notice'>We use cookies to make this site work and to count our visitors. You can read more in our policy.</div>"),
        ("", "<main>"),
        ("+", "<h1>Winter show</h1>"),
        ("+", "<p>From November the lower hall shows work of forty makers from nine countries, most of it lent by private owners and never seen before.</p>"),
        ("+", "<p>Tours start at ten and at three.</p>"),
        ("+", "<table><tr><td>Monday</td><td>closed</td></tr></table>"),
        ("", "<aside>"),
        ("-", "<p>Become a friend of the museum and come in free all year, with one guest, and get our letter every month.</p>"),
        ("", "</aside>"),
        ("+", "<p>Children under twelve pay nothing if they come with an adult, and school classes should write to us two weeks ahead.</p>"),
        ("", "</main>"),
        ("-", "<footer><p>Museum of Glass, 4 Mill Lane. Open every day but Monday from ten until six in the evening.</p></footer>"),
        ("", "</body>"),
    ],
    [
        ("", "<body><table><tr><td>"),
        ("-", "<a href='x'>Up</a> | <a href='y'>Next</a> | <a href='z'>Index</a>"),
        ("", "</td></tr></table>"),
        ("+", "<h1>Chapter four</h1>"),
        ("+", "<p>When the train came in at last the platform was nearly empty, and the two of them stood under the clock without a word between them.</p>"),
        ("+", "<p>She laughed.</p>"),
        ("+", "<p>It was the same clock, he thought, and the same wind that came in from the yards with a smell of coal and of wet iron.</p>"),
        ("-", "<p><a href='x'>Back to contents</a></p>"),
        ("-", "<div class='share'>Share this page on <a href='f'>one</a>, <a href='g'>two</a> or <a href='h'>three</a></div>"),
        ("", "</body>"),
    ],
    [
        ("", "<body><div class='topbar'>"),
        ("-", "Call us on weekdays between nine and five"),
        ("", "</div><div class='post'>"),
        ("+", "<h1>Release notes</h1>"),
        ("+", "<p>This version reads old files again and writes new ones faster than before; see <a href='/doc'>the guide</a> for what to change.</p>"),
        ("+", "<pre>run --all --fast</pre>"),
        ("+", "<p>Thanks to all who sent reports.</p>"),
        ("", "</div><div class='related'>"),
        ("-", "<h4>Related posts</h4>"),
        ("-", "<p>A look back at the first ten years of the project and at the people who made it what it has become.</p>"),
        ("", "</div><div class='newsletter'>"),
        ("-", "<p>Sign up for our letter and hear of new versions first. No spam, and you can leave whenever you like.</p>"),
        ("", "</div><div class='banner'>"),
        ("-", "<p>Autumn sale: all plans are cheaper by a third for new customers who sign before the end of the month.</p>"),
        ("", "</div></body>"),
    ],
    [
        ("", "<body><div role='navigation'>"),
        ("-", "<span>You are here:</span> <a href='/'>Start</a> <a href='/t'>Travel</a>"),
        ("", "</div><section>"),
        ("+", "<h2>Over the pass on foot</h2>"),
        ("+", "<p>The path leaves the village behind the church and climbs through larch woods for two hours before the first hut comes into view.</p>"),
        ("+", "<h3>Water</h3>"),
        ("+", "<p>There is none above the hut until late June, so carry what you need.</p>"),
        ("+", "<p>From the pass one sees three countries on a clear day, and on most other days the inside of a cloud, which has its own charm.</p>"),
        ("", "</section><div class='promo'>"),
        ("-", "Boots at half price"),
        ("", "</div><div id='disqus_thread'>"),
        ("-", "<p>Lovely walk, we did it last year in the rain and would do it again at once, with better shoes this time.</p>"),
        ("", "</div><div class='legal'>"),
        ("-", "<a href='/terms'>Terms</a> <a href='/privacy'>Privacy</a> &copy; 2020"),
        ("", "</div></body>"),
    ],
]
