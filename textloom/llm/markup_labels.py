"""A small labelled table for the markup classifier: documents as lists of (kinds, block), written for this purpose.

``kinds`` names the markup a block holds (several parted by a blank), or is empty for prose and for the
signs of a printed edition.
"""

DOCUMENTS: list[list[tuple[str, str]]] = [
    [("html", "<p>The board shall meet in <b>May</b> and in June.</p>"), ("html", "<ul><li>one report</li><li>two copies</li></ul>"), ("", "It keeps a record of each meeting.")],
    [("html", '<section id="S12"><enum>4.</enum><header>Ferry safety</header>'), ("html", "<text>The operator shall report.</text></section>"), ("", "The operator may appeal within 30 days.")],
    [("", "SEC. 3. GRANTS FOR HARBORS."), ("html", "The term &ldquo;harbor&rdquo; means a port under &sect;&nbsp;12."), ("html", "A fee applies.<br>It is due in June.")],
    [("html", "&lt;em&gt;notice&lt;/em&gt; shall be given"), ("", "by mail and in a newspaper of the county.")],
    [("html", "The <!-- item 4 --> clerk certifies the list."), ("html", "<TABLE><tr><td>12</td><td>40</td></tr></TABLE>"), ("", "Total 52.")],
    [("html", "The clerk&mdash;or a deputy&mdash;signs it."), ("html", '<a href="https://example.org/x">the register</a>'), ("html", '<font size="2">Approved</font>')],
    [("html", "under &#167; 7 of this act"), ("html", "DIVISION I&mdash;PORTS"), ("", "the list of ports")],
    [("wiki", "[https://acts.example.org/list the list]"), ("wiki", "I agree. ~~~~"), ("", "[the list]"), ("", "The clerk agrees.")],
    [("wiki", "See [https://acts.example.org/port harbor act]. ~~~~"), ("", "See https://acts.example.org/port for the act."), ("", "about ~40 ports")],
    [("html", "An owner of <i>record</i> may object."), ("html", "<h3>Notices</h3>"), ("html", "SEC. 9.<BR>"), ("html", "shall <div class='note'>not be less than 10")],
    [("", "Passed the House of Representatives."), ("", "<all>"), ("", "[[Page 308]]"), ("", "[Star Print]")],
    [("", "The rule applies if 3 < 61 or income is <$42,000 and >$500."), ("", "R&D costs of lot #292 (see Brown & Sons v. Board)."), ("", "* * * * *")],
    [("", "____________________________________"), ("", "*Note: $707.50 per fee, $73 per permit."), ("", "{reserved}")],
    [("", "Box A\\5, bridge_toll = 14; x^2 of the lot."), ("", "Amounts above $1,200,000 and up to $3,000,000 remain available."), ("", "----------")],
    [("", "AT&T and Smith & Co. filed (a) an answer; (b) a motion."), ("", "5 > 3 and 4 < 9"), ("", "Page 21 of 43"), ("", "=== == ==")],
    [("", "The chair’s ‘own’ motion -- see item #4 -- failed, 3-2 *"), ("", "cost_center = 5"), ("", "[H.R. 2021 Referred in Senate (RFS)]"), ("", "To direct the Secretary to publish a list.")],
    [("markdown", "## Findings and purpose"), ("", "The Congress finds the following."), ("markdown", "This is **very** plain."), ("markdown", "The __first__ report is due.")],
    [("markdown", "See [the list](https://example.org/list/4)."), ("markdown", "![seal](/img/4.png)"), ("markdown", "~~Repealed~~ by Public Law 1-2.")],
    [("markdown", "```"), ("markdown", "toll_rate = 4"), ("markdown", "```"), ("", "The rate is set each year.")],
    [("markdown", "| item | amount |"), ("markdown", "|---|:---:|"), ("markdown", "| ferry | 20 |"), ("", "The amounts are in dollars.")],
    [("markdown", "Purposes"), ("markdown", "======"), ("markdown", "> The board shall consult each county."), ("markdown", "Use `form 4` for a claim.")],
    [("markdown", "# Title"), ("markdown", "**(a)** In general."), ("markdown", "`(2)` any other fee; and"), ("", "(3) each fine.")],
    [("wiki", "== Findings =="), ("wiki", "The [[Clean Water Act|act]] applies."), ("wiki", "'''Secretary''' means the head."), ("", "It applies to all.")],
    [("wiki", "{{cite act|name=Harbor|year=1963}}"), ("wiki", "[[Category:Public law]]"), ("wiki", "A ''short'' title."), ("wiki", "=== Ports ===")],
    [("wiki", '{| class="wikitable"'), ("wiki", "! port !! fee"), ("wiki", "|-"), ("wiki", "| 71 || 27"), ("wiki", "|}"), ("", "The table lists fees.")],
    [("wiki", "paid.{{Citation needed|date=May 2010}}"), ("wiki", "any [[harbor master|master]] who"), ("", "fails to file a return shall pay.")],
    [("latex", "\\section{Findings}"), ("latex", "The share equals $\\frac{4}{x_{3} + 7}$ of the sum."), ("latex", "see section~\\ref{sec:ports}.")],
    [("latex", "\\begin{itemize}"), ("latex", "\\item by 20 percent for ports"), ("latex", "\\end{itemize}"), ("", "and no more.")],
    [("latex", "\\emph{harbor} means"), ("latex", "under\\,\\S~45 of this act"), ("latex", "\\[ r_{t+1} = \\sum_{i=1}^{5} w_i r_i \\]"), ("latex", "the term\\footnote{as amended} applies")],
    [("latex", "\\subsection*{Ports}"), ("latex", "\\textbf{Board} and \\underline{clerk}"), ("latex", "\\paragraph{Notice} is given."), ("", "It is due in June.")],
    [("", "The board approves the list of each port and keeps it."), ("", ""), ("", "======"), ("", ""), ("", "Approved")],
    [("", "Printed by the clerk"), ("", ""), ("", "=========="), ("", "12")],
    [("", "The fees are due."), ("markdown", "Harbor dues"), ("markdown", "==========="), ("", "A due is paid each year.")],
    [("", "The rate follows."), ("markdown", "```"), ("markdown", "if tonnage > 40:"), ("markdown", "    toll = 9"), ("markdown", "```"), ("", "if it is due")],
    [("html markdown", "<p>See **the list**.</p>"), ("html latex", "<b>note</b> \\textit{and} text"), ("wiki latex", "[[port|ports]] and \\emph{fees}"), ("html wiki", "&mdash; '''bold''' &nbsp;")],
]
