"""Sentences of general knowledge that the abuse model is fitted on beside the labels, so that it knows words no label has."""

from __future__ import annotations

import re

import numpy as np

# Words of the slots.
SLOTS = {
    "insult": "idiot, moron, imbecile, cretin, jerk, asshole, bastard, bitch, prick, dickhead, wanker, tosser, twat, cunt, loser, scumbag, dumbass, jackass, douche, shithead, clown, retard, pig, creep, coward, "
    "degenerate, parasite, dimwit, halfwit, dipshit, numbskull, knobhead, arsehole, motherfucker, cocksucker, slut, whore, troll, piece of shit, piece of trash, waste of space, sack of crap",
    "adj": "stupid, worthless, pathetic, disgusting, ugly, brainless, filthy, useless, miserable, ignorant, fucking, dumb, lousy, sick, lying, fat, ridiculous, spineless",
    "group": "women, men, gays, lesbians, trans people, muslims, jews, christians, black people, asians, arabs, mexicans, immigrants, migrants, refugees, foreigners, old people, teenagers, disabled people, "
    "poor people, gypsies, these people, people like you, your sort, that lot, religious people, girls, boys, the unemployed",
    "noun": "battery, screen, case, lens, cable, charger, keyboard, camera, phone, speaker, update, firmware, button, strap, mount, app, headset, laptop, sensor, fan, tripod, adapter, manual, warranty, router, card, hinge, shop",
    "body": "tits, boobs, ass, pussy, cock, dick, cunt, nipples, naked body, bare chest, thighs, lips",
    "harm": "jump off a cliff, jump under a train, walk into the sea, drink bleach, swallow poison, hang yourself, drown, drop dead, rot in a cell, choke, burn, bleed out, set yourself on fire, end it, starve, get run down by a truck",
    "hurt": "kill, stab, shoot, beat, strangle, punch, hurt, cut, drown, burn, hit, smash, bury, find, hunt, whip, choke",
    "place": "house, street, school, office, job, hospital, grave, prison, sleep, car, way home, morgue",
    "lewd": "lick, suck, fuck, spank, kiss, squeeze, touch, grab, bang, taste, rub, ride, finger, undress, tie up, lie on",
    "lust": "horny, naked, wet, hard, hot, aroused, nude, topless",
    "kin": "parents, mother, father, family, kids, wife, teachers, friends, dog, brother",
    "vice": "thieves, liars, criminals, parasites, savages, trash, scum, cockroaches, vermin, rats, pigs, inferior, dirty, lazy, backward, subhuman",
    "doing": "read, think, vote, drive, work, own a {noun}, use a {noun}, speak, live here, have a job, be trusted, post here",
    "job": "seller, reviewer, moderator, author, guy, woman, neighbour, man at the shop",
}

# Sentences that insult, threaten or demean, or are sexually explicit.
ABUSE = """you are a {adj} {insult} | what a {insult} you are | shut up {insult} | {insult} | go to hell {insult} | you {adj} {insult} | you {insult} | how can anyone be this {adj} | you have the brain of a goldfish
are you brain dead or what | nobody likes you | no one cares what a {insult} thinks | your mother raised a {insult} | get a life {insult} | kiss my ass | screw you | eat shit | fuck off | fuck this {insult} | suck my {body}
go screw yourself | you make me sick | even a monkey is smarter than you | you are dumber than a brick | what is wrong with you {insult} | you are a disgrace to your family | log off {insult} | the {job} is a {insult}
the {job} who wrote this is a {adj} {insult} | only a {insult} would write that | you were born stupid | you cannot even read {insult} | learn to read you {adj} {insult} | who asked you {insult} | you all are {insult} s | all of you are {adj} {insult} s
bunch of {insult} s in here | you stink | you are uglier than a toad | your face makes babies cry | your wife must be blind | your kids will be ashamed of you | you are the dumbest person alive | you are not worth the air you breathe
you are nothing but dirt | crawl under your rock | what kind of {insult} says this | your {kin} must be sorry for you | your {kin} should be ashamed | even your {kin} think you are {adj} | were you dropped on your head | did your {kin} drop you | my {kin} is smarter than you | too {adj} to {doing}
you are too {adj} to {doing} | go away {insult} | get out {insult} | leave {insult} | true {insult} | a real {insult} | complete {insult} | total {insult} , go away | every day a new {insult} | spoken by a {insult} | one more {insult} with a keyboard
everything you write shows you are {adj} | nobody wants you here | you are a waste of skin | you are garbage | you are all the same , {insult} s | piss off | you can all piss off | fuck your {kin} | fuck all of you | stop breathing my air | nice try {insult} | cry more {insult} | ok {insult} | another {insult} who knows nothing | say that to my face {insult}
{group} are animals | {group} are a disease | all {group} should be deported | {group} do not deserve to live | {group} are inferior | {group} belong in the kitchen | get rid of all {group} | {group} have no place here | lock up all {group}
{group} are rats | {group} cannot be trusted | {group} are lazy and steal | {group} always lie and cheat | go back to your country | i hate {group} | {group} must be exterminated | no {group} could ever understand this | send {group} home
{group} are {vice} | all {group} are {vice} | {group} are too {adj} to {doing} | {group} cannot {doing} | {vice} , all {group} | {group} again , {vice} as ever | it is in the genes of {group} | {group} should not {doing} | who lets {group} {doing}
i would never let {group} {doing} | {group} steal your money , that is their nature | do not trust {group} | throw {group} out | {group} ruined this town | we do not want {group} here | {group} out | wipe out {group} | {group} smell bad | {group} are not human | {group} have tiny brains | do not sell to {group} , they rob you | {group} should not be allowed to vote | ban all {group} | {group} destroy our country | {group} are the problem , kick them out
i am sick of {group} , they are all criminals | this is what happens when you let {group} in | {group} are dirty | a real man does not listen to {group}
i am going to kill you | i will kill you | i will beat you up | i will hunt you down | we know where you live | i know where your kids go to school | watch your back tonight | you will pay for this with your life | i hope you die | i hope you get cancer
go kill yourself | kill yourself | hang yourself | drink bleach | someone should shoot you | you deserve a bullet | i will smash your face | i will slit your throat | next time i see you i stab you | better lock your doors | i come to your house and hurt you
the world would be better without you | no one will cry when you are gone | you should never have been born | your mother should have swallowed you | step in front of a train | throw yourself off a roof | i will make you suffer | you will end in a grave
i am coming for you | enjoy your last day | you need a good beating | somebody ought to smack you | one more word and i break your jaw | i will cut you to pieces | burn in hell | you will not wake up tomorrow | i want to see you bleed
they should hang you | you had better not walk home alone | stop posting or you get hurt | i will ruin your life | choke on it and die
please {harm} | why do you not {harm} | i hope you {harm} | do us a favor and {harm} | people like you should {harm} | go and {harm} , {insult} | you should {harm} | you and your {kin} can {harm} | {harm} already
i will {hurt} you | i will {hurt} you and your {kin} | someone should {hurt} you | i know your {place} | i am waiting at your {place} | you will wake up in the {place} | i put you in the {place} | say it again and i {hurt} you | nobody will come to your grave
one day somebody will {hurt} you | you better hide , i know the {place} | you deserve to {harm} | they will find your body | no one would notice if you were dead | your {kin} would be better off if you were gone | your {kin} will cry at your grave
i want to fuck you | suck my cock | send nudes | i want to see you naked | take off your clothes | come to bed with me | let me lick your {body} | spread your legs | i am touching myself | my pussy is so wet | he came all over her face
she gave me a blowjob | hot girls want sex tonight | join my cam show | let me grab your {body} | i would do her all night | she has huge {body} , i want to squeeze them | jerking off to this video | anal sex with my girlfriend last night
he has a huge boner | i get so hard when i look at her | sit on my lap sexy | i bet she moans loud | make me cum | moan for me | dirty slut wants it | look at her {body} | what a hot piece of ass | i want to bang her | i need a good fuck
naked milf waiting for you | free porn and live sex here | my {body} is hard for you | i want your {body} in my mouth | show me your {body} | she rides him all night | lonely housewives want to get laid | see my {body} on my page | undress for me baby
{lewd} me baby | {lewd} me all night | i want to {lewd} you | i want to {lewd} her | {lewd} my {body} | come and {lewd} my {body} | let me {lewd} you on the bed | she can {lewd} me any day | he makes me {lust} | i feel so {lust} tonight | {lust} girls near you
{lust} and ready for you | get {lust} with me on camera | i am {lust} , come over | pictures of my {body} | your {body} please | {body} pics now | {body} in my bio | baby you make me scream | from behind until you scream | i would smash that all night | put it in my mouth | she took her panties off | i dream about her {body} | slide into my bed
du bist ein arschloch | verpiss dich | leck mich am arsch | du wichser | du hurensohn | fick dich | du blöde schlampe | geh sterben du missgeburt | so ein dummer idiot bist du | ich bring dich um
hijo de puta | vete a la mierda | eres un idiota | chupame la polla | cabron de mierda | pendejo | que te jodan | muerete imbecil | maldita puta | te voy a matar
ta gueule | fils de pute | nique ta mere | sale con | espece d enfoire | grosse salope | je vais te tuer | ferme ta gueule | quel abruti | sale merde
vaffanculo | stronzo | figlio di puttana | pezzo di merda | vai se foder | filho da puta | klootzak | rot op | kurwa | spierdalaj | suka blyat"""

# Harmless sentences, many with words that abuse has too.
HARMLESS = """kill the app and restart | dead pixel in the corner | master and slave drives | the {noun} is killing me | the {noun} sucks | shitty {noun} | fucking great {noun} | damn good {noun} | what a crap {noun} | this {noun} is junk
the {noun} is a bitch to install | holy shit this {noun} is fast | hell , the {noun} broke | stupid {noun} died again | dumb {noun} design | the {noun} blew up | shoot in raw | shoot me a message | nice headshot lens | i shot the bride and groom
hit the button twice | beat the traffic | crush the blacks in the edit | the whites are blown | hot pixels everywhere | hot swap the {noun} | the hard drive is loud | male to female adapter | the female connector is loose | nude colour case
strip the insulation | bare wire | naked bike mount | wet the cloth first | rubber grip feels nice | screw it in tight | tighten the nuts | ball head is loose | cockpit view | cocktail party | essex shop | assess the class | bass is huge
cumulative update | a cat on the {noun} | great bird photo | chicken breast recipe | moby dick on tape | execute the job | abort the install | terminate the thread | hang the picture | killer deal | murder on the {noun} | die cast metal | the {noun} dies at noon
the {noun} is dying | fire up the {noun} | bomb proof {noun} | the deal is a steal | i nearly had a heart attack at the price | cut the cable | blow on the contacts | suck the air out | pull the trigger on it | the fan screams | the plug is exposed
stick it to the back | the desk mount holds | the model is slim and sexy | bloody fast {noun} | hell of a {noun} | oh shit , wrong {noun} | fuck , i dropped it | the {noun} is shit | ugly {noun}
ridiculous price | useless {noun} | pathetic battery life | worthless {noun} , returned it | disgusting smell from the {noun} | filthy lens | sick photos | a beast of a {noun} | garbage sound | this thing is trash | the {noun} is a joke
someone called me a {insult} | he told me to fuck off and got banned | i reported the {insult} comment | please do not use slurs | calling people {insult} is not ok | mods removed the threats | harassment is against the rules | stop insulting each other
the guy who wrote {insult} was suspended | i got death threats for my review | racist comments get deleted here | do not feed the trolls | a user threatened her and was banned | nobody should be called a {insult} | no insults please
i am such an idiot , i forgot to charge it | i felt stupid | silly me | my dumb ass left it in the rain | i am a moron for buying two | i was a {insult} and paid too much | i could kick myself | call me a {insult} but i like it
{group} in my family use it | my gay friend loves it | a shop for {group} | made for {group} too | the centre for {group} got donated phones | foreign currency | immigrant visa photos | disabled access is good | sizes for {group} | black and white models
{group} in my class have the same {noun} | many {group} like the big screen | discount for {group} | a guide for {group} | old lenses are great | poor light | women and men fit alike | girls size strap
you should try the {noun} | thank you for the help | i hope you enjoy it | you are right | your {noun} is fine | if i were you i would return it | i will find the manual for you | you will love it | do you want to sell it | i know which {noun} you mean
see you tomorrow | send me a link | show us the {noun} | let me know where you bought it | tell me more about the {noun} | where do you live , shipping depends on it | ask your dad | nobody told me about the {noun}
listen to it first | i want to see the {noun} | who wants to buy my {noun} | you lot are great | everyone here is helpful | you need two of them
wait until you get the update | worth every cent | hot deal | hot summer | long night of gaming | my hand hurts | in my hand it feels small | my lap gets warm | the face unlock is slow | all night battery
you too | are you sure | you wish | you must be new here | do you mean the {noun} | you can say that again | what do you think | your dad was right | ask your {job} | talking to you | i mean you | no , you | you two | you there | good for you
i saw the {job} at the shop | the {job} was kind | the {job} sent a new {noun} | nobody answered me | people here know a lot | people like the {noun} | somebody should test the {noun} | someone broke the {noun} | they are all sold out
vielen dank | das funktioniert gut | das kabel ist kaputt | ich habe die gleiche kamera | muchas gracias | no funciona la bateria | la pantalla es buena | el sonido es claro | merci beaucoup | je ne sais pas | le son est bon | ca marche bien
grazie mille | obrigado | bedankt | schlechte akku laufzeit | me gusta mucho | tres bonne photo | kein problem | de nada | bonne journee | gute nacht
kill the {noun} job | kill the {noun} before you start | the {noun} hits hard | the {noun} is tight | cheap as hell | loud as hell | a dumb {noun} is enough for my dad | a stupid simple {noun} | all she needs is a {noun} | great {noun} , great {noun}
the {noun} beats the {noun} | the {noun} kicks ass | crap {noun} , good {noun} | damn , the {noun} | the bloody {noun} is stuck | no sex appeal , this {noun} | a sexy little {noun} | hard case for the {noun} | the naked {noun} is thin | shoot the {noun} with a {noun}
the {noun} nuts are tight as fuck | tight fit , the {noun} and the {noun} | a dumb {noun} is all i want | a dumb old {noun} with a {noun} is all you need | my {kin} needs a dumb {noun} | a nude {noun} without a {noun} breaks fast | the bare {noun} scratches
shoot the {noun} at night with a {noun} | never shoot without a {noun} | the {noun} shoots fine | hang the {noun} on the wall | the {noun} is toast | burn the {noun} image | cut the {noun} in half | the {noun} smells | mount the {noun} on your bed | the {noun} is exposed | suck the dust out of the {noun} | a {noun} for women
same | agreed | nice | why | when | where from | price | thanks | fixed it | it works | how long | any news | wow | lol | no | yes | ok | deleted | removed | typo"""

_SLOT = re.compile(r"\{(\w+)\}")
_WORDS = {k: v.split(", ") for k, v in SLOTS.items()}


def sentences(of: str) -> list[str]:
    return [s.strip() for line in of.splitlines() for s in line.split("|") if s.strip()]


def filled(sentence: str, rng: np.random.Generator, nouns: list[str] = ()) -> str:
    """sentence with a random word in each slot; nouns, if given, are used half of the time."""

    def word(m):
        if m[1] == "noun" and len(nouns) and rng.random() < 0.5:
            return nouns[int(rng.integers(len(nouns)))]
        return _WORDS[m[1]][int(rng.integers(len(_WORDS[m[1]])))]

    while "{" in sentence:
        sentence = _SLOT.sub(word, sentence)
    return sentence
