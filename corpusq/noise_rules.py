"""Noise rules and promo settings of the cleaning engine, as data."""

from __future__ import annotations

from dataclasses import dataclass

@dataclass(frozen=True)
class NoiseRule:
    """How far a cut reaches around a match (strategy), the pattern, and what else is known of it."""

    name: str
    strategy: str
    pattern: str
    ignore_case: bool = False
    truncation: bool = False
    foreign_headlines: bool = False
    ranking_label: bool = False


# --- Fixed values: noise rules, in the order they run ---
NOISE_RULES = [
    NoiseRule("paywall_premium", "span", r"PREMIUM\s+Upgrade to read this .*?Already have a subscription\?\s*Sign in", truncation=True),
    NoiseRule("editorial_update_note", "span", r"\(Updates? (?:with|to) [^()]{1,120}\)"),
    NoiseRule("continue_reading", "span", r"\bContinue Reading\b", truncation=True),
    NoiseRule("story_continues", "span", r"\bStory Continues\b"),
    NoiseRule("view_comments", "span", r"\bView Comments\b\s*\|?"),
    NoiseRule("yahoo_video_carousel", "span", r"Related Videos(?:\s+\d{1,2}:\d{2}(?::\d{2})?\s+.{1,200}?\s+\d+\s+(?:minutes?|hours?|days?)\s+ago)+"),
    NoiseRule("motley_fool_footer", "to_end", r"Should you invest \$[\d,]+ in [^?]{1,60} right now\?"),
    NoiseRule("motley_fool_double_down_footer", "to_end", r"Don't miss this second chance at a potentially lucrative opportunity"),
    NoiseRule("zacks_footer", "to_end", r"Why Haven't You Looked at Zacks' Top Stocks\?"),
    NoiseRule("zacks_recommendations_footer", "to_end", r"Want the latest recommendations from Zacks Investment Research\?"),
    NoiseRule("benzinga_unlocked_footer", "to_end", r"UNLOCKED: \d+ NEW TRADES EVERY WEEK"),
    NoiseRule("thefly_footer", "to_end", r"(?:Filter, analyze, and streamline your search|Published first on TheFly)"),
    NoiseRule("simply_wall_st_footer", "to_end", r"Have feedback on this article\?"),
    NoiseRule("investopedia_footer", "to_end", r"The comments, opinions, and analyses expressed on Investopedia"),
    NoiseRule("benzinga_footer", "to_end", r"\bUp Next\s*:"),
    NoiseRule("bloomberg_most_read", "promo_block", r"Most Read from Bloomberg(?: Businessweek)?", foreign_headlines=True),
    NoiseRule("read_next", "promo_block", r"\bread next\s*:", ignore_case=True),
    NoiseRule("read_also", "promo_block", r"\bREAD ALSO\s*:"),
    NoiseRule("read_more", "promo_block", r"\(?\bread more(?: on [A-Z.]+)?\s*:", ignore_case=True),
    NoiseRule("dont_miss", "promo_block", r"\bDon't Miss\s*:"),
    NoiseRule("trending", "promo_block", r"\bTrending\s*:"),
    NoiseRule("see_also", "promo_block", r"\bSee Also\s*:"),
    NoiseRule("insider_monkey_cross_promo", "sentence", r"(?:In another article,? we discussed|please check out our hedge fund investor letters|Why are we interested in the stocks that hedge funds)"),
    NoiseRule("sponsored_deloitte", "promo_block", r"(?:Inspired by Uber and Airbnb - )?Deloitte's (?:#1 )?fastest-growing software company"),
    NoiseRule("sponsored_foldable_home", "promo_block", r"Maker of the \$[\d,]+ foldable home"),
    NoiseRule("sponsored_invest_today", "promo_block", r"You can invest today for just"),
    NoiseRule("sponsored_bezos_fund", "promo_block", r"If there was a new fund backed by Jeff Bezos"),
    NoiseRule("sponsored_bezos_landlord", "promo_block", r"This Jeff Bezos-backed startup"),
    NoiseRule("sponsored_entrepreneurs", "promo_block", r"These five entrepreneurs are worth"),
    NoiseRule("sponsored_retirement", "promo_block", r"(?:Many are using retirement income calculators|The average American couple has saved this much|Can you guess how many Americans|The percentage may shock you)"),
    NoiseRule("sponsored_age_savings", "promo_block", r"If You're Age \d+"),
    NoiseRule("sponsored_alt_assets", "promo_block", r"(?:BlackRock is calling \d{4} the year of alternative assets|One firm from NYC has quietly built a group of|CEO of Integris gathered a team)"),
    NoiseRule("sponsored_real_estate", "span", r"Many don't know there are tax benefits when buying a unit as an investment - Here's how to invest in real estate by mirroring BlackRock's big move"),
    NoiseRule("market_research_cta", "span", r"(?:Get a Sample Report|Make an Enquiry Now|Buy an Enterprise-User PDF|Access Complete Report Details|Acquire our comprehensive analysis today|Download Brochure)[^@]{0,120}@"),
    NoiseRule("benzinga_edge", "sentence", r"(?:Benzinga Edge|Get the latest stock analysis from Benzinga)"),
    NoiseRule("thestreet_pro", "sentence", r"TheStreet Pro"),
    NoiseRule("insider_monkey_promo", "sentence", r"(?:we are obsessed with the stocks that hedge funds pile into|outperform the market by imitating|check out our report about the cheapest AI stock|While we acknowledge the potential of)"),
    NoiseRule("newsletter_promo", "sentence", r"\bnewsletter", ignore_case=True),
    NoiseRule("gurufocus_warning", "span", r"Warning! GuruFocus has detected \d+ Warning Signs? with [A-Z.]+\.?"),
    NoiseRule("tipranks_thefly", "sentence", r"(?:TipRanks|Published first on TheFly)"),
    NoiseRule("try_now", "span", r"Try Now\s*>+"),
    NoiseRule("zacks_cross_promo", "sentence", r"(?:complete list of today's Zacks #1 (?:\(Strong Buy\) )?Rank|all of today's research reports here|You can read today's AWS here|please check out our weekly Earnings Trends report)"),
    NoiseRule("zacks_report_link", "span", r"\(You can read the full research report on [^()]{1,80} here\s*>+\)"),
    NoiseRule("click_here", "sentence", r"\bclick (?:here|now)\b", ignore_case=True),
    NoiseRule("disclosure", "sentence", r"\bDisclosure\s*:"),
    NoiseRule("originally_published", "sentence", r"\boriginally (?:published|appeared) (?:at|on|in|by)\b", ignore_case=True),
    NoiseRule("copyright", "sentence", r"(?:©\s*\d{4}|All rights reserved|does not provide investment advice)", ignore_case=True),
    NoiseRule("read_original", "sentence", r"Read the original article on"),
    NoiseRule("credit_image_getty_contributor", "span", r"-?\s*Image:\s*[^()]{1,60}\(Getty Images\)"),
    NoiseRule("credit_getty_parenthetical", "span", r"\([^()]{0,80}Getty Images\)"),
    NoiseRule("credit_via_getty", "span", r"[A-Z][\w]*(?: [A-Z][\w]*)* via Getty Images"),
    NoiseRule("credit_slash_getty", "span", r"\b\w+/Getty Images"),
    NoiseRule("credit_image_source_getty", "span", r"Image [Ss]ource:\s*Getty Images\.?"),
    NoiseRule("credit_image_source_repeated", "span", r"\b([A-Z][\w.&-]*(?:\s+(?:[A-Z][\w.&-]*|and|of|the)){0,4})\s+Image [Ss]ource:\s*\1(?!\w)"),
    NoiseRule("credit_photo_agency", "span", r"-?\s*Photo:\s*[^/()]{1,50}/[A-Z]\w+"),
    NoiseRule("credit_photo_parenthetical", "span", r"\(Photo:\s*[^)]{1,60}\)"),
    NoiseRule("contact_author_sentence", "sentence", r"(?:\bEmail (?:him|her|them|[A-Z][a-z]+ [A-Z][a-z]+) at\b|\bEmail [\w.+-]+@|\bFor more information,? visit\b|\b[Ff]ollow (?:him|her|them|us|[A-Z][a-z]+) on\b|\bTips on stories\?)"),
    NoiseRule("contact_social_handle", "span", r"(?<![\w@])@[A-Za-z_][\w.]{2,}"),
    NoiseRule("contact_email", "span", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    NoiseRule("contact_email_obfuscated", "span", r"[\w.+-]+\s*\(at\)\s*[\w-]+(?:\.[\w-]+)+"),
    NoiseRule("contact_phone", "span", r"(?<![\w.,$/-])(?:\+?1[-. ])?(?:\(\d{3}\)\s?|\d{3}[-.])\d{3}[-.]\d{4}(?:\s*ext\.?\s*\d+)?(?![\w%/-]|[.,]\d)"),
    NoiseRule("zacks_rank_label", "span", r"Zacks Rank\s*#?\d\s*\([^)]*\)", ranking_label=True),
]

# --- Fixed values: promo blocks and footers ---
PROMO_WORDS, PROMO_PROBE, PROMO_BOUNDARY, FOOTER_WORDS = 60, 4, 4, 6
#: Characters at a word's edges that are not part of it.
EDGES = "\"'([{)]}.,;:!?-"
CONNECTORS = "a an the and but or nor for so yet on at to from by of in with as vs via into over up off out".split()
OPENERS = "The A An This These Those That It It's Its In On As At For But And However Meanwhile He She They We I Our Their His Her Instead While After Before According".split()
END_MARKERS = ["Disclosure:", "Story Continues", "View Comments", "READ NEXT", "Read Next:", "READ ALSO", "Read More", "Up Next:", "Don't Miss:", "Trending:", "Most Read from", "See Also:"]
BOILERPLATE = [r"Motley Fool", r"Stock Advisor", r"Zacks", r"Simply Wall St", r"Investopedia", r"Benzinga", r"disclosure policy", r"has positions in", r"has no position", r"Free Stock Analysis Report", r"free report", r"made the cut", r"our recommendation", r"made this list", r"top 10 list", r"Should you invest", r"Before you buy stock", r"Learn more", r"stock-picking", r"average gains?", r"live picks", r"Past performance", r"potential for loss", r"informational purposes", r"recommendation to buy", r"should not be assumed", r"current as of the date", r"views or opinions", r"hypothetical portfolios", r"actual portfolios", r"unmanaged index", r"performance numbers", r"latest recommendations", r"\bdownload\b", r"\bclick\b", r"originally (published|appeared)", r"general in nature", r"financial advice", r"fundamental data", r"price-sensitive", r"feedback on this article", r"Concerned about the content", r"Get in touch", r"editorial", r"warranty and liability", r"does not own any of the above", r"Read the original article", r"Media Contact", r"Transform your trading", r"unique insights", r"latest stock analysis", r"View Comments", r"investment banking", r"returns as of", r"monster returns", r"doubled? down", r"missed the boat", r"missed your chance", r"numbers speak for themselves", r"another chance like this", r"TipRanks", r"TheFly", r"Read More on", r"trade ideas", r"NEW TRADES"]
