"""The rules that hold for every product, and those of the product for people over sixty."""

from placeweave.operators.rules import KeywordRule, RuleSet, TypeRule

DEFAULTS = RuleSet(
    reject_types=(
        TypeRule("reject_type_government", ("local_government_office", "city_hall", "courthouse")),
        TypeRule("reject_type_finance", ("bank", "atm", "finance")),
        TypeRule("reject_type_fuel", ("gas_station", "car_repair", "car_wash")),
        TypeRule("reject_type_education_admin", ("primary_school", "secondary_school", "university")),
        TypeRule("reject_type_private_no_public_activity", ("real_estate_agency", "insurance_agency", "accounting", "lawyer", "dentist", "doctor")),
        TypeRule("reject_type_shopping_mall", ("shopping_mall",)),
        TypeRule("reject_type_grocery", ("supermarket", "grocery_store", "food_store")),
        TypeRule("reject_type_sublocality_political", ("sublocality", "sublocality_level_1", "political", "administrative_area_level_1", "administrative_area_level_2")),
    ),
    reject_keywords=(
        KeywordRule("reject_keyword_language_school", ("escola de idiomas", "curso de ingles", "curso de inglês", "wizard", "wise up", "cna idiomas", "fisk")),
        KeywordRule("reject_keyword_driving_school", ("autoescola", "auto escola", "cfc ")),
        KeywordRule("reject_keyword_legal_office", ("advocacia", "advogados", "escritorio de advocacia")),
        KeywordRule("reject_keyword_government_office", ("secretaria municipal", "secretaria de estado", "prefeitura de", "camara municipal", "cartorio", "cartório")),
        KeywordRule("reject_keyword_bank_branch", ("banco do brasil", "caixa economica", "caixa econômica", "bradesco", "itau", "itaú", "santander")),
    ),
    accept_types=(
        TypeRule("accept_type_theater", ("performing_arts_theater",)),
        TypeRule("accept_type_museum", ("museum",)),
        TypeRule("accept_type_cultural_center", ("cultural_center",)),
        TypeRule("accept_type_library", ("library",)),
        TypeRule("accept_type_park", ("park",)),
        TypeRule("accept_type_art_gallery", ("art_gallery",)),
    ),
)

OVER_SIXTY = RuleSet(
    accept_keywords=(
        KeywordRule("accept_keyword_convivencia", ("centro de convivencia", "centro de convivência", "centro do idoso", "centro da terceira idade")),
        KeywordRule("accept_keyword_clube_social", ("clube social", "clube recreativo", "associacao recreativa", "associação recreativa")),
        KeywordRule("accept_keyword_espaco_cultural", ("espaco cultural", "espaço cultural")),
    ),
    review_keywords=(
        KeywordRule("review_keyword_feira", ("feira de", "feira livre", "feira municipal")),
        KeywordRule("review_keyword_praca", ("praca ", "praça ")),
        KeywordRule("review_keyword_centro_historico", ("centro historico", "centro histórico")),
        KeywordRule("review_keyword_monumento", ("monumento", "memorial")),
    ),
    review_types=(
        TypeRule("review_type_tourist_attraction", ("tourist_attraction",)),
        TypeRule("review_type_food_uncertain", ("restaurant", "food", "cafe", "bar")),
    ),
    weak_reviews=("review_type_tourist_attraction",),
    reinforcement=KeywordRule("accept_keyword_activity_name_match", ("hidroginastica", "hidroginástica", "natacao", "natação", "danca", "dança", "terceira idade", "idosos", "idoso", "aquatica", "aquática", "aquafit", "aqua")),
    fallback=TypeRule("fitness_generic_type", ("gym", "fitness_center", "sports_activity_location", "sports_club", "sports_school", "sports_complex", "health", "yoga_studio")),
    fallback_label="likely_fitness_generic",
    fallback_reason="Provável academia/estúdio genérico, sem indicação clara de atender o público 60+",
)
